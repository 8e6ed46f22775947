import hashlib

from paperloom.llm import fingerprints as G
from pyspark.sql import functions as F


def edited(rows):
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        c = len(t) // 3
        out[i] = hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()
    return out


def test_edited_and_next(spark, make):
    rows = [(i * 7 - 20, " ".join(f"w{(i * k) % 91}é" for k in range(i % 23 * 9))) for i in range(200)] + [(5000, None), (5001, "😀 tiny")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in (40, 4, 1):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = G.edited_fingerprints(make(rows)).collect()
            assert {r.doc_id: r.edited_sha256 for r in got} == edited(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_equal_texts_and_estimates(spark, make):
    base = " ".join(f"t{k}" for k in range(4000))
    half = " ".join(f"t{k}" for k in range(2000)) + " " + " ".join(f"s{k}" for k in range(2000))
    df = make([(1, base), (2, base), (3, half), (4, "a b"), (5, None), (6, "t1 t2 t3 t4 t5 t6 t7")])
    s = {r.doc_id: r.sketch for r in G.fingerprints(df).collect()}
    assert s[1] == s[2] and s[5] == [] and len(s[4]) == 1 and 380 < len(s[1]) < 620
    two = spark.createDataFrame([(s[1], s[3])], "a array<long>, b array<long>").select(
        G.likeness(F.col("a"), F.col("b")).alias("j"), G.containment(F.col("b"), F.col("a")).alias("c"), F.size(G.union(F.col("a"), F.col("b"))).alias("u"))
    r = two.first()
    assert abs(r.j - 1 / 3) < 0.08 and abs(r.c - 0.5) < 0.1 and r.u == len(set(s[1]) | set(s[3]))


def test_odd_rows(spark, make):
    from llm_cases import ODD

    got = G.edited_fingerprints(make(ODD)).collect()
    assert len(got) == len(ODD)
    one = G.edited_fingerprints(make([(1, "a b c d e f")])).first()
    assert one.near_next == 1.0
    assert G.edited_fingerprints(make([])).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_short_texts_are_compared_whole(spark, make):
    texts = {i: " ".join(f"q{(i // 2 * 7 + k) % 50}" for k in range(5 + i % 9)) for i in range(60)}
    got = {r.doc_id: r for r in G.edited_fingerprints(make(list(texts.items()))).collect()}
    for i, t in texts.items():
        nxt = texts[(i - 1) % 60]
        c = len(t) // 3
        for other, near in ((t[: len(t) - c] + nxt[:c], got[i].near_edited), (nxt, got[i].near_next)):
            a, b = shingles(t), shingles(other)
            assert abs(near - len(a & b) / len(a | b)) < 1e-12
        assert len(got[i].fingerprint) <= 17 + 16 * len(shingles(t))


def test_sketches_of_a_scale_unite_and_contain(spark, make):
    short = {i: " ".join(f"a{i}x{k}" for k in range(6)) for i in range(40)}
    rows = [(i, t) for i, t in short.items()] + [(100 + i, t + "".join(f" b{i}y{k}" for k in range(60))) for i, t in short.items()]
    for scale in (1, 2, 8):
        s = {r.doc_id: r for r in G.fingerprints(make(rows), scale=scale).collect()}
        assert all((r.sketch is None) == (r.n_shingles_kept == 0) for r in s.values())
        pairs = spark.createDataFrame([(i, s[i].sketch, s[100 + i].sketch) for i in short], "i long, a array<long>, b array<long>")
        for r in pairs.select("a", "b", G.containment(F.col("a"), F.col("b")).alias("c"), G.likeness(F.col("a"), F.col("b")).alias("j"), G.union(F.col("a"), F.col("b")).alias("u")).collect():
            assert r.c == (None if r.a is None else 1.0) and (r.j is None) == (r.a is None or r.b is None)
            assert r.u == r.b  # the long text holds the short one
        assert scale == 8 or any(r.sketch for r in s.values())


def test_identifiers_of_any_order(spark):
    rows = [(f"id{i:03}", f"text of {i} " * 5) for i in range(50)] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = edited([r for r in rows if r[0]])
    assert {r.doc_id: r.edited_sha256 for r in G.edited_fingerprints(df).collect() if r.doc_id} == want


def test_fingerprints_are_the_retained_hashes(spark, make):
    texts = {i: " ".join(f"W{(i * 3 + k) % 40}" for k in range(i % 12 * 4)) for i in range(60)}
    got = {r.doc_id: r for r in G.edited_fingerprints(make(list(texts.items()))).collect()}
    every = {r.doc_id: r.sketch for r in G.fingerprints(make(list(texts.items())), scale=G.WHOLE).collect()}
    least = -(1 << 63) + (1 << 64) // G.KEPT
    kept = {i: every[i] if len(t.split()) < G.WORDS else [h for h in every[i] if h < least] for i, t in texts.items()}
    for i, t in texts.items():
        assert len(every[i]) == len(shingles(t))
        assert got[i].fingerprint.split(":")[1] == "".join(f"{h % (1 << 64):016x}" for h in kept[i])
        for j, u in texts.items():
            assert (got[i].fingerprint == got[j].fingerprint) == (shingles(t) == shingles(u))
            assert len(set(every[i]) & set(every[j])) == len(shingles(t) & shingles(u))
        for a, b, share in ((i, (i - 1) % 60, got[i].kept_in_next), ((i - 1) % 60, i, got[i].next_in_kept)):
            want = len(set(kept[a]) & set(kept[b])) / len(kept[a]) if kept[a] else None if every[a] else 1.0
            assert share == want


def test_containment_in_a_far_longer_text(spark, make):
    short = [f"s{k}" for k in range(400)]
    long = [f"l{k}" for k in range(20000)]
    rows = [(1, " ".join(long[:9000] + short[:200] + long[9000:])), (2, " ".join(short)), (3, " ".join(long[500:520])), (4, " ".join(long))]
    got = {r.doc_id: r for r in G.edited_fingerprints(make(rows)).collect()}
    true = len(shingles(rows[1][1]) & shingles(rows[0][1])) / len(shingles(rows[1][1]))
    assert abs(got[2].kept_in_next - true) < 0.15 and got[2].next_in_kept < 0.03
    # 20 words in 20,000: whatever is retained of the 20 words is retained of the long text
    assert got[4].next_in_kept in (1.0, None) and got[4].kept_in_next < 0.01
    assert all(len(got[i].fingerprint) < len(t) * 1.1 + 40 for i, t in rows)
