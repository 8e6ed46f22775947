"""N-gram Jaccard join: a size-aware heavy-light join over word shingles.

Documents with equal shingle sets form a class, one representative of which takes part.  Two sets of n and m shingles link
when they share at least o(n, m) = ceil(num * (n + m) / (num + den)) of them.

* Small sets enumerate subsets of fixed size: a set of n emits, for each size m of a possible partner, all its subsets of
  o(n, m) shingles.  Equal subsets are links, without any comparison; those who share one are tied to its smallest member.
* Large sets scan inverted lists: in one order of all shingles the first n - ceil(num * n / den) + 1 of a set must meet
  those of a partner, so only these are listed.  The order is that of the hashes with shingles that many documents share
  (passages, phrases) at the end, so that they are listed only for sets that hold little else.  What meets on a list is
  filtered by size, by what comes before the first shared shingle, and by a parity sketch, whose bits never differ more
  than the sets do, and then compared in full.

The boundary between the two is the size at which the summed cost of subsets, by the histogram of sizes, is least above
that of lists.  Lists of more than a few members do not compare all pairs.  First each member is compared with the list's
leader and what is linked is contracted; then the pairs of different components that are left are compared, size band by
size band, so that a long list is many keys.  No pair is dropped at any point.

Heads and sketches of all documents are hashed and written once; texts are read again only to compare candidates in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, durable, table
from .components import connected
from .hashing import mix, release_memory, text_shingles

#: Sets up to this size carry all their shingles, so that any boundary up to it can be chosen.
SMALL_MOST = 31
#: Lists up to this length compare all pairs of components at once.
SHORT = 8
#: Shingles counted at once in a task, count in one such part from which a shingle is reported, least sum of these counts of a
#: common shingle, and common shingles at most (they are broadcast; which they are changes the cost and not the result).
PART, REPORTED, COMMON_LEAST, COMMON_MOST = 1 << 21, 2, 24, 1 << 18
#: Cost of a listed shingle (its list and the comparisons that follow), in subset keys.
LIST_COST = 8
#: Bits of the table that marks the documents to be compared in full (4 MB).
SLOTS = 1 << 25


def least_overlap(n: int, m: int, num: int, den: int) -> int:
    return -(-num * (n + m) // (num + den))


def partners(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subset_count(n: int, num: int, den: int) -> int:
    return sum(comb(n, o) for m in partners(n, num, den) if (o := least_overlap(n, m, num, den)) <= n)


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """The largest size that enumerates subsets: where the total cost over the histogram of sizes is least."""
    best, best_cost, cost = 0, 0, 0
    for n in range(1, SMALL_MOST + 1):
        cost += histogram.get(n, 0) * (subset_count(n, num, den) - LIST_COST * prefix_length(n, num, den))
        if cost <= best_cost:
            best, best_cost = n, cost
    return best


def _parity(hashes: np.ndarray) -> bytes:
    """One bit for each residue of the hashes: whether an odd number has it; about as many bits as hashes."""
    bits = 1 << min(16, max(6, (len(hashes) - 1).bit_length()))
    odd = np.bincount(((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _parity_distance(a: bytes, b: bytes) -> int:
    """Differing bits; the longer sketch is folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> np.ndarray:
    """Shingles that many documents share, sorted; all data is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            some = counts >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], ["token", "c"])

        parts, held = [], 0
        for b in batches:
            for s in text_shingles(b.column("text"), n):
                parts.append(s)
                held += len(parts[-1])
                if held > PART:
                    yield counted(parts)
                    parts, held = [], 0
        yield counted(parts)
        release_memory()

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    top = counts.filter(F.col("c") >= COMMON_LEAST).orderBy(F.desc("c"), "token").limit(COMMON_MOST).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def shingle_heads(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, d1, d2, head, parity), written: size and digest of each set, its first shingles in order, its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n, num, den, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in batches:
            size, d1, d2, heads, parity = [], [], [], [], []
            for s in text_shingles(b.column("text"), n):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                size.append(len(s))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(common) and len(s):
                    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    s = np.concatenate((s[~late], s[late]))
                heads.append(s[: len(s) if len(s) <= SMALL_MOST else prefix_length(len(s), num, den)].view(np.int64))
                parity.append(_parity(s))
            columns = [b.column("doc_id"), pa.array(size, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "head", "parity"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    written = durable(rows.mapInArrow(run, f"doc_id {kind}, n int, d1 long, d2 long, head array<long>, parity binary"))
    shared.destroy()
    return written


def _subset_links(classes: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """(a, b): links between sets of at most x shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, rep, low = [], [], [], []
            for r, head in zip(b.column("rep").to_pylist(), b.column("head"), strict=True):
                own = head.values.to_numpy().view(np.uint64)
                n = len(own)
                marks = np.stack((mix(own), mix(own ^ np.uint64(0x5851F42D4C957F2D))), 1)
                for m in partners(n, num, den):
                    o = least_overlap(n, m, num, den)
                    if o > n or m > x:
                        continue
                    out = np.array(list(combinations(range(n), n - o)), np.int64).reshape(comb(n, o), n - o)
                    sums = marks.sum(0, dtype=np.uint64) - marks[out].sum(1, dtype=np.uint64)
                    keys = mix(sums + np.uint64(min(n, m) * 64 + max(n, m))).view(np.int64)
                    k1.append(keys[:, 0]), k2.append(keys[:, 1])
                    rep += [r] * len(keys)
                    low += [int(n <= m)] * len(keys)
            cat = np.concatenate
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat([none, *k1])), pa.array(cat([none, *k2])), pa.array(rep, b.column("rep").type), pa.array(low, pa.int32())], ["k1", "k2", "rep", "low"])

    kind = classes.schema["rep"].dataType.simpleString()
    keys = classes.filter(F.col("n") <= x).select("rep", "head").mapInArrow(run, f"k1 long, k2 long, rep {kind}, low int")
    # a key names the sizes of a pair; all that have it link with one of the smaller size, and those of that size with each other
    hubs = keys.groupBy("k1", "k2").agg(F.min(F.when(F.col("low") == 1, F.col("rep"))).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND hub IS NOT NULL")
    return keys.join(hubs, ["k1", "k2"]).filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def _fits(x: int, num: int, den: int) -> Column:
    """Sizes n and n2 that can link, not both small, given the places i and i2 of a shingle.

    What comes before the first shared shingle is in one set only, so i + i2 and the difference of what follows is no more
    than the sets may differ.  A pair that links passes this at its first shared shingle.
    """
    n, m, i, j = (F.col(c).cast("long") for c in ("n", "n2", "i", "i2"))
    low, high = F.least(n, m), F.greatest(n, m)
    most = n + m - 2 * F.ceil((n + m) * num / F.lit(num + den))
    return (low * den >= high * num) & (high > x) & (i + j + F.abs((n - i) - (m - j)) <= most)


def _marked(left: DataFrame) -> np.ndarray:
    """A bit table of fixed size that marks the identifiers of the pairs (a, b)."""
    ids = left.select(F.explode(F.array("a", "b")).alias("rep")).select(F.pmod(F.xxhash64("rep"), F.lit(SLOTS)).alias("slot"))
    words = ids.groupBy((F.col("slot") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()  # at most SLOTS / 64 rows
    return out


def _compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The links among distinct candidate pairs (a, b): by parity sketch first, then in full.

    Whole sets are made of marked documents only, so others are passed over before anything is shuffled; the joins that
    follow are exact, however full the bit table is.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_numpy().astype(np.int64), b.column("m").to_numpy().astype(np.int64)
            most = n + m - 2 * -(-num * (n + m) // (num + den))
            keep = [_parity_distance(p.as_buffer(), q.as_buffer()) <= k for p, q, k in zip(b.column("p"), b.column("q"), most, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column("s"), b.column("t"), strict=True):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = classes.schema["rep"].dataType.simpleString()
    first = classes.select(F.col("rep").alias("a"), "n", F.col("parity").alias("p"))
    second = classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("parity").alias("q"))
    left = durable(pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "p", "q").mapInArrow(near, f"a {kind}, b {kind}"))
    marked = docs.sparkSession.sparkContext.broadcast(_marked(left))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        for b in batches:
            slots = b.column("slot").to_numpy()
            some = b.filter(pa.array((bits[slots >> 6] >> (slots & 63)) & 1 == 1))
            own = pa.array([s.tobytes() for s in text_shingles(some.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("rep"), own], ["rep", "set"])
        release_memory()

    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS)).alias("slot")
    found = durable(docs.filter("rep IS NOT NULL").select("rep", slot, "text").mapInArrow(sets, f"rep {kind}, set binary"))
    marked.destroy()
    s, t = found.select(F.col("rep").alias("a"), F.col("set").alias("s")), found.select(F.col("rep").alias("b"), F.col("set").alias("t"))
    # an identifier with several texts may bring a pair several times
    return durable(left.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(linked, f"a {kind}, b {kind}"))


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, labels): (doc_id, n, rep) for every row, and (node, label) for the representatives that have a link.

    See ``jaccard_components`` for what rows and links are.
    """
    if not 2 * num > den >= num > 0:
        raise ValueError("the least similarity num / den lies above a half and is at most 1")
    heads = shingle_heads(docs, n, num, den, id_col, text_col)
    some = heads.filter("n > 0 AND doc_id IS NOT NULL")
    classes = durable(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("parity").alias("parity")))
    takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    members = heads.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    members = durable(members.select("doc_id", "n", F.when(takes_part, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"), takes_part.alias("takes_part")))

    sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= SMALL_MOST).groupBy("n").count().collect()}
    x = boundary(sizes, num, den)
    links = _repeated(members)
    if x:
        links = links.unionByName(_subset_links(classes, x, num, den))
    links = durable(links)

    large = classes.filter(F.col("n") * den > x * num)  # those above x, and what is near enough to them
    size = F.col("n")
    prefix = (size - F.ceil(size * num / F.lit(den)) + 1).cast("int")
    postings = large.select("rep", "n", F.posexplode(F.slice("head", F.lit(1), prefix)).alias("i", "token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    lists = durable(postings.join(counts, "token").select("token", "rep", "n", "i", "c"))
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()

    fits = _fits(x, num, den)
    # the leader has least before the shingle, so it is the one nearest to all others
    own = lists.filter(F.col("c") > SHORT)
    who = F.struct(F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    leaders = own.groupBy("token").agg(F.min_by(who, F.struct("i", F.xxhash64("rep"))).alias("w")).select("token", "w.*")
    found = _compare(ordered(own.join(leaders, "token").filter((F.col("rep") != F.col("rep2")) & fits)), classes, texts, n, num, den)
    labels = connected(links.unionByName(found))

    rows = lists.select("token", "rep", "n", "i").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    found = _compare(ordered(_cross(durable(rows), fits, num, den)), classes, texts, n, num, den)
    labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found))
    return members.select("doc_id", "n", "rep"), labels


def _repeated(members: DataFrame) -> DataFrame:
    """(a, b): an identifier that repeats with other texts is one document: its classes are tied together."""
    own = members.filter("takes_part").select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("doc_id")
    return own.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _cross(rows: DataFrame, fits: Column, num: int, den: int) -> DataFrame:
    """(rep, rep2): pairs of different components on a list, each member of all but its largest component with all.

    Sizes that can link lie in the same band of sizes or in neighbouring ones, so lists are joined by (token, band).
    """
    shares = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = shares.groupBy("token").agg(F.max(F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    main = main.filter("labels > 1").select("token", F.col("main.label").alias("main"))
    width = 1.001 * log(den / num) if den > num else 1e-9
    mixed = rows.join(main, "token").withColumn("band", F.floor(F.log("n") / F.lit(width)))
    other = mixed.filter("label <> main").select("token", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("label").alias("label2"), "band")
    other = other.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    met = mixed.join(other, ["token", "band"]).filter((F.col("label") != F.col("label2")) & fits)
    return met.filter((F.col("label") == F.col("main")) | (F.col("rep") < F.col("rep2"))).select("rep", "rep2")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    Words are runs between ASCII white space, A-Z in lower case; a set holds the distinct n-word shingles of a whole text,
    or its whole word sequence where it has fewer words; a text without words (a null one too) has none and links with
    nothing.  Sets link when den * intersection >= num * union.  ``component_id`` is the smallest identifier that links
    reach.  Rows that repeat an identifier are one document; rows without an identifier link with nothing and have a
    null component.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows, labels = jaccard_links(docs, n, num, den, id_col, text_col)
    out = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those whose component has a smaller identifier."""
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op7_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


OP7_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS c FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (sizes - c) UNION SELECT b, a FROM p WHERE 100 * c >= 90 * (sizes - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = s.doc_id"""
