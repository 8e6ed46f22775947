import random
import re

import pytest

from paperloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and (i == j or den * both >= num * len(s | t)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, sizes, copies, edits):
    random.seed(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = [random.choice(words) for _ in range(40)]
    rows = []
    for size in sizes:
        base = [random.choice(words) for _ in range(size)]
        for c in range(copies):
            own = list(base)
            for _ in range(random.randint(0, edits)):
                own[random.randrange(size)] = random.choice(words)
            if c == 2:
                own += passage
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_like_brute_force(spark, make, n, num):
    rows = corpus(1, [8, 11, 12, 13, 16, 21, 24, 33, 34, 60, 90, 200], 12, 3) + [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (905, "one two")]
    got = J.jaccard_components(make(rows), n, num, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, num, 100)


def test_one_large_group_and_common_passage(spark, make, monkeypatch):
    monkeypatch.setattr(J, "COMMON_LEAST", 4)
    rows = corpus(2, [70], 150, 4) + [(i + 500, " ".join(f"p{k}" for k in range(50)) + f" own{i} " + " ".join(f"u{i}_{k}" for k in range(40))) for i in range(60)]
    got = J.jaccard_components(make(rows), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90, 100)


def test_odd_rows(spark, make):
    from llm_cases import ODD

    got = J.jaccard_components(make(ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is None} == {(None, None)}
    assert all(r.component_id == r.doc_id for r in got)
    # an identifier with two texts is one document and ties their groups
    text = " ".join(f"a{k}" for k in range(30))
    other = " ".join(f"b{k}" for k in range(30))
    got = J.jaccard_components(make([(1, text), (2, text), (2, other), (3, other), (9, "q w e r t y u")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)}
    assert J.jaccard_components(make([])).count() == 0
    kept = J.drop_near_duplicates(make([(1, text), (2, text + " z"), (None, text), (4, None), (5, None)]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "None"]


def test_bounds():
    for n in range(1, 60):
        for m in J.partners(n, 80, 100):
            o = J.least_overlap(n, m, 80, 100)
            assert 100 * o >= 80 * (n + m - o) and not 100 * (o - 1) >= 80 * (n + m - o + 1)
            if o <= min(n, m):
                assert o >= n - J.prefix_length(n, 80, 100) + 1
    with pytest.raises(ValueError):
        J.jaccard_links(None, 3, 50, 100)


def test_crafted_words_do_not_link(spark, make):
    from llm_cases import crafted

    import pyarrow as pa

    from paperloom.llm.hashing import text_shingles

    words = [w for k in (10, 11, 12, 20) for w in crafted(k)]
    hashes = [h.tolist() for h in text_shingles(pa.array(words), 3)]
    assert len({x for h in hashes for x in h}) == len(words)
    a, b = crafted(11)
    docs = make([(1, f"{a} {a} {b}"), (2, f"{b} {b} {a}"), (3, f"{a} {a} {b}"), (4, a), (5, b)])
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    kept = {r.doc_id for r in J.drop_near_duplicates(make([(1, a), (2, b), (3, f"{a} x y z w"), (4, f"{b} x y z w")])).collect()}
    assert kept == {1, 2, 3, 4}
