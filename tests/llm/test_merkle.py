import hashlib
import random

from llm_cases import ODD
from pyspark.sql import functions as F

from paperloom.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        a = i // 16 * 16
        yield nodes[a:i], nodes[i + 1 : a + 16]
        i //= 16


def brute(rows, changed):
    """rows: (doc_id, source, ...); doc_id, leaf, subroot, root, proof digest, folded root."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, tops = {}, []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, tree([leaf(r) for r in own])
        tops.append(trees[s][1][-1][0])
    top, out = tree(tops), []
    for k, s in enumerate(order):
        own, levels = trees[s]
        for i, r in enumerate(own):
            proof = [*siblings(levels, i), *siblings(top, k)]
            node = leaf(changed(r))
            for left, right in proof:
                node = H(*left, node, *right)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], H(*[x for left, right in proof for x in (*left, *right)]), node))
    return sorted(map(str, out))


def check(spark, rows, changed=lambda r: r, replaced=None):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "pos": F.lit(2), "digest": F.lit("y")})
    got = M.merkle_manifest(docs, replaced=replaced, proofs=True).collect()
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root)) for r in got) == brute(rows, changed)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert all(M.fold_proof(r.leaf, [tuple(x) for x in r.proof]) == r.root for r in got)
    return got


def test_like_brute_force(spark):
    rng, rows = random.Random(5), []
    for source, n in [("hot", 1500), (None, 17), ("", 1), ("é", 16), ("Z", 257), ("a", 256), ("b", 2), *[(f"s{k}", 1) for k in range(30)]]:
        rows += [(rng.randrange(10**6), source, rng.choice([None, "en"]), k, rng.choice([None, "", "Text É ", "lower"]) if k % 3 else f"T{k}") for k in range(n)]
    rng.shuffle(rows)
    changed = lambda r: (*r[:4], r[4].replace("T", "t")) if r[4] and r[0] % 5 == 0 else r
    fields = [F.translate("text", "T", "t") if c == "text" else F.col(c) for c in M.FIELDS]
    got = check(spark, rows, changed, F.when(F.col("doc_id") % 5 == 0, M.field_digest(*fields)))
    assert {r.verified for r in got} == {True, False}


def test_one_leaf_one_source_and_none(spark):
    (only,) = check(spark, [(7, "s", "en", 3, "abc")])
    assert only.leaf == only.subroot == only.root and only.proof == [] and only.proof_sha256 == H("")
    assert check(spark, [(k, "s", None, None, None) for k in range(18)])[0].verified
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.merkle_manifest(docs).count() == 0


def test_odd_rows(spark):
    check(spark, [(i, s, None, None, t) for i, t in ODD for s in ("s", None)])


def test_block_states():
    nodes = [H(str(k)).encode() for k in range(200)]
    block = M.Block(nodes, 2)
    for i in range(0, 200, 7):
        changed = [*nodes]
        changed[i] = H("x").encode()
        assert block.fold(i, changed[i]) == M.Block(changed, 2).root and block.fold(i, nodes[i]) == block.root
