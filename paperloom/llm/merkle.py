"""Merkle manifest of a dataset: a tree of SHA-256 digests per source and one over the sources.

Leaves get their place in their source from a range partition and counts per part, so a source that holds most rows is many
parts.  A tree is cut into blocks of ``BLOCK`` neighbours, two levels of it; block roots are the nodes of the next tier.
Inside a block every parent keeps a copy of its hash state from before each child, so a changed child resumes that state
and reads what stands to its right only.  Digests above a block come down to it as one row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, durable, table

#: Children of a parent, and nodes of a block: FAN * FAN, so a block is two levels.
FAN = 16
BLOCK = FAN * FAN
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one key of a join has at most, as a shift.
_CHUNK = 6


def field_digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other: `-` for a null, else the UTF-8 byte count, `:` and the value as text."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[part(v) for v in values]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


class Block:
    """Some neighbouring nodes and the levels above them; ``states[k][i]`` is the parent's hash state before node i of level k."""

    def __init__(self, digests: list[bytes], levels: int):
        self.states: list[list] = []
        self.runs: list[list[bytes]] = []
        for _ in range(levels):
            states, runs, parents = [], [], []
            for a in range(0, len(digests), FAN):
                h = hashlib.sha256()
                for d in digests[a : a + FAN]:
                    states.append(h.copy())
                    h.update(d)
                runs.append(b"".join(digests[a : a + FAN]))
                parents.append(h.hexdigest().encode())
            self.states.append(states)
            self.runs.append(runs)
            digests = parents
        self.root = digests[0]

    def siblings(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """What stands left and right of the node and of its ancestors, level by level."""
        for runs in self.runs:
            up, slot = divmod(i, FAN)
            yield runs[up][: slot * HEX], runs[up][(slot + 1) * HEX :]
            i = up

    def fold(self, i: int, node: bytes) -> bytes:
        """The root with ``node`` in place i: each parent resumes its state, then reads the siblings on the right."""
        for states, runs in zip(self.states, self.runs, strict=True):
            up, slot = divmod(i, FAN)
            h = states[i].copy()
            h.update(node)
            h.update(runs[up][(slot + 1) * HEX :])
            node, i = h.hexdigest().encode(), up
        return node


class Above:
    """The levels above a block, of one node each: the state after its left siblings, and the right ones."""

    def __init__(self, path: str):
        self.levels = [tuple(x.encode().split(b",")) for x in path.split(";") if x]
        self.states = [hashlib.sha256(left) for left, _ in self.levels]

    def fold(self, node: bytes) -> bytes:
        for state, (_, right) in zip(self.states, self.levels, strict=True):
            h = state.copy()
            h.update(node)
            h.update(right)
            node = h.hexdigest().encode()
        return node


def fold_proof(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf digest and its proof (left and right siblings, level by level) give."""
    return Above(";".join(f"{left},{right}" for left, right in proof)).fold(leaf.encode()).decode()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first two columns; a group is a block and the row above it, so it is small."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, own in itertools.groupby(rows, itemgetter(0, 1)):
        yield key, list(own)


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in its tree from 0, and ``n``, the nodes of the tree."""
    placed = durable(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    parts = placed.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("tree", "first", "last", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    starts = starts.select("tree", "n", (F.col("before") - F.col("first")).alias("shift"), F.explode(F.sequence(F.shiftright("first", _CHUNK), F.shiftright("last", _CHUNK))).alias("chunk"))
    return placed.withColumn("chunk", F.shiftright("at", _CHUNK)).join(starts, ["tree", "chunk"]).withColumn("pos", F.col("at") + F.col("shift")).drop("chunk", "at", "shift")


def _levels(n: int) -> int:
    return 2 if n > BLOCK else height(n)


def _lift(nodes: DataFrame) -> DataFrame:
    """One row per block of a tier: (tree, pos, n, digest) of the tier above, and whether it is the root of its tree."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_())])

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (tree, block), own in _groups(batches):
                n = own[0][3]
                yield tree, block, -(-n // BLOCK), Block([r[4].encode() for r in own], _levels(n)).root.decode(), n <= BLOCK

        return _sent(rows(), schema)

    rows = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest")
    return _together(rows).mapInArrow(lift, "tree string, pos long, n long, digest string, whole boolean")


def _forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of all trees, lowest first, and their roots (tree, tier, digest)."""
    tiers, roots = [nodes.select("tree", "pos", "n", "digest")], None
    while True:
        up = durable(_lift(tiers[-1]))
        ended = up.filter("whole").select("tree", F.lit(len(tiers) - 1).alias("tier"), "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        rest = up.filter("NOT whole").drop("whole")
        if rest.isEmpty():
            return tiers, roots
        tiers.append(rest)


def _with_paths(nodes: DataFrame, paths: DataFrame, extra: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks of ``nodes``, each after the row with its path; ``extra`` gives the types of ``columns``."""
    own = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest", F.lit(None).cast("string").alias("path"), *columns)
    above = paths.select("tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "path", *[F.lit(None).cast(extra.schema[c].dataType).alias(c) for c in columns])
    return _together(own.unionByName(above))


def _own_path(block: Block, i: int, above: str) -> str:
    return ";".join([*[f"{left.decode()},{right.decode()}" for left, right in block.siblings(i)], above])


def _down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, block, path): the path of each node, which is a block of the tier below."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.string())])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (tree, _), (top, *own) in _groups(batches):
                block = Block([r[4].encode() for r in own], _levels(own[0][3]))
                for i, r in enumerate(own):
                    yield tree, r[2], _own_path(block, i, top[5])

        return _sent(rows(), schema)

    return _with_paths(nodes, paths, nodes, []).mapInArrow(down, "tree string, block long, path string")


def _paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, block, path) of the blocks of the lowest tier, from the path (tree, tier, path) of each root."""
    paths = None
    for i in reversed(range(len(tiers))):
        here = tops.filter(F.col("tier") == i).select("tree", F.lit(0).cast("long").alias("block"), "path")
        paths = here if paths is None else here.unionByName(_down(tiers[i + 1], paths))
    return paths


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", replaced: Column | None = None, proofs: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, with ``proofs`` also proof.

    A leaf is the digest of ``fields`` (see ``field_digest``).  Leaves of one ``tree_col`` ascend by identifier (null first,
    equal ones by digest); runs of 16 become their digest until one node, the subroot, is left, and subroots by
    ``tree_col`` (null first, then bytewise) give the root in the same way.  ``replaced`` is the digest to hold against the
    manifest, null where it is the leaf itself: it is folded with the siblings of the manifest into folded_root, and
    ``verified`` says whether that is the root.  ``proof`` has the siblings left and right of the leaf and of each
    ancestor below the root; proof_sha256 is the digest of all of them, that of nothing where there are none.

    Rows that repeat an identifier are leaves of their own, and equal ones have equal digests.  Extra columns count for
    nothing; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    leaf = field_digest(*[F.col(f"`{c}`") for c in fields])
    tree = F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(tree_col).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"), (F.lit(None).cast("string") if replaced is None else replaced).alias("replaced"))
    nodes = durable(ranked(leaves, ["doc_id", "digest", "replaced"]))
    tiers, roots = _forest(nodes)
    roots = durable(roots)
    tops = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "tier", "digest"), ["own"])
    top_tiers, top = _forest(tops)
    top_paths = _paths(top_tiers, top.select("tree", "tier", F.lit("").alias("path")))

    def to_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, (above, *own) in _groups(batches):
                block = Block([r[4].encode() for r in own], _levels(own[0][3]))
                for i, r in enumerate(own):
                    yield r[6], r[7], "/" + _own_path(block, i, above[5])

        return _sent(rows(), pa.schema([("tree", pa.string()), ("tier", pa.int32()), ("path", pa.string())]))

    tree_paths = _with_paths(tops, top_paths, tops, ["own", "tier"]).mapInArrow(to_trees, "tree string, tier int, path string")
    paths = _paths(tiers, durable(tree_paths))

    out = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<left: string, right: string>>" * proofs
    texts = [("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
    if proofs:
        texts.append(("proof", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def rows():
            for _, (above, *own) in _groups(itertools.chain([first], batches)):
                block = Block([r[4].encode() for r in own], _levels(own[0][3]))
                inner, _, outer = above[5].partition("/")
                in_tree, over = Above(inner), Above(outer)
                subroot = in_tree.fold(block.root)
                root = over.fold(subroot)
                rest = b"".join(x for above in (in_tree, over) for pair in above.levels for x in pair)
                for i, r in enumerate(own):
                    proof = list(block.siblings(i))
                    digest = hashlib.sha256(b"".join(x for pair in proof for x in pair) + rest).hexdigest()
                    folded = over.fold(in_tree.fold(block.fold(i, (r[7] or r[4]).encode())))
                    found = [r[6], r[4], subroot.decode(), root.decode(), digest, folded.decode(), folded == root]
                    if proofs:
                        found.append([{"left": a.decode(), "right": b.decode()} for a, b in [*proof, *in_tree.levels, *over.levels]])
                    yield tuple(found)

        yield from _sent(rows(), pa.schema([("doc_id", first.schema.field("doc_id").type), *texts]))

    return _with_paths(nodes, paths, nodes, ["doc_id", "replaced"]).mapInArrow(fold, f"doc_id {id_type.simpleString()}, {out}")


def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = field_digest(*[ascii_lower(F.col("text")) if c == "text" else F.col(c) for c in FIELDS])
    return merkle_manifest(docs, replaced=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed))


def _sql() -> str:
    def field(x: str, text: bool = False) -> str:
        v = x if text else f"CAST({x} AS VARCHAR)"
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([field('doc_id'), field('source', True), field('lang', True), field('n_chars'), field(text, True)])})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    octets = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    step = "list_reduce(list_prepend(xor(a, b), CAST(range(8) AS UBIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {octets}), lambda a, b: {step}), CAST(4294967295 AS UBIGINT))"
    parts = [
        f"l AS MATERIALIZED (SELECT *, {leaf('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f0 FROM documents)",
        "d0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS p0, count(*) OVER (PARTITION BY source) AS n0 FROM l)",
        "t0 AS (SELECT source, p0 AS p, n0 AS n, d FROM d0)",
    ]

    def levels(prefix: str, count: int, key: str) -> None:
        for k in range(count):
            parts.append(f"{prefix}r{k} AS MATERIALIZED (SELECT {key}, p // 16 AS p, n, string_agg(d, '' ORDER BY p) AS run FROM {prefix}{k} GROUP BY {key}, p // 16, n)")
            parts.append(f"{prefix}{k + 1} AS MATERIALIZED (SELECT {key}, p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS d FROM {prefix}r{k})")

    deep, wide = 6, 4
    levels("t", deep, "source")
    parts.append(f"s AS MATERIALIZED (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM t{deep})")
    parts.append("u0 AS (SELECT 0 AS k, p, n, d FROM s)")
    levels("u", wide, "k")
    rows, at = "(SELECT d0.*, s.p AS q, s.n AS m, s.d AS subroot, '' AS proof FROM d0 JOIN s ON s.source IS NOT DISTINCT FROM d0.source)", 0
    for prefix, count, place, n in (("t", deep, "p0", "n0"), ("u", wide, "q", "m")):
        for k in range(count):
            same = f"r.source IS NOT DISTINCT FROM x.source AND r.p = x.{place} // 16" if prefix == "t" else f"r.p = x.{place} // 16"
            left, right = f"substr(r.run, 1, 64 * (x.{place} % 16))", f"substr(r.run, 64 * (x.{place} % 16) + 65)"
            parts.append(
                f"w{at} AS MATERIALIZED (SELECT x.* REPLACE (x.{place} // 16 AS {place}, (x.{n} + 15) // 16 AS {n}, CASE WHEN x.{n} = 1 THEN x.f0 ELSE sha256({left} || x.f0 || {right}) END AS f0, CASE WHEN x.{n} = 1 THEN x.proof ELSE x.proof || {left} || {right} END AS proof) FROM {rows} x JOIN {prefix}r{k} r ON {same})"
            )
            rows, at = f"w{at}", at + 1
    return f"WITH {', '.join(parts)} SELECT doc_id, x.d AS leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, f0 AS folded_root, f0 = t.d AS verified FROM {rows} x, u{wide} t"


OP11_SQL = _sql()
