from paperloom.llm import exact_dedup as D


def brute(rows, largest=True):
    tr = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(tr), []).append(i)
    pick = max if largest else min
    return {(i, pick(g), len(g)) for g in groups.values() for i in g}


def test_groups_and_kept(spark, make):
    rows = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "abc ")]
    got = D.exact_duplicates(make(rows), keep="largest").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute(rows)
    assert {r.doc_id for r in got if r.kept} == {2, 3, 4, 6, 7}
    assert {r.doc_id for r in D.drop_exact_duplicates(make(rows)).collect()} == {1, 3, 4, 5, 7}


def test_hot_text_is_salted_and_merged(spark, make, monkeypatch):
    monkeypatch.setattr(D, "HOT_LEAST", 5)
    rows = [(i, "Same" if i % 2 else "same") for i in range(300)] + [(i, f"t{i}") for i in range(300, 500)]
    got = D.exact_duplicates(make(rows), keep="largest").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute(rows)
    assert sum(r.kept for r in got) == 201


def test_repeats_nulls_and_empty(spark, make):
    rows = [(4, "a"), (4, "A"), (None, "a"), (None, None)]
    got = D.exact_duplicates(make(rows)).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 4
    assert {r.keep_id for r in got if r.doc_id == 4} == {4}
    assert D.exact_duplicates(make([])).count() == 0


def test_rows_are_dropped_as_rows(spark, make, monkeypatch):
    rows = [(None, "only one"), (1, "a"), (2, "x"), (2, "a"), (3, None), (None, ""), (7, "L" * 200_000), (8, "l" * 200_000), (None, "n"), (None, "N")]
    for least in (1000, 1):
        monkeypatch.setattr(D, "HOT_LEAST", least)
        df = make(rows)
        got = D.drop_exact_duplicates(df)
        assert got.columns == df.columns
        got = [(r.doc_id, r.text) for r in got.collect()]
        assert sorted(i or 0 for i, _ in got) == [0, 0, 1, 2, 3, 7] and len(got) == 6
        assert {(None, "only one"), (1, "a"), (2, "x"), (3, None)} <= set(got)
        every = D.exact_duplicates(df, keep="smallest").collect()
        assert sum(r.kept for r in every) == 6 and len(every) == len(rows)
    assert D.drop_exact_duplicates(make([])).count() == 0


def test_salts_by_size(spark, make, monkeypatch):
    monkeypatch.setattr(D, "HOT_LEAST", 10)
    rows = [(i, "big") for i in range(400)] + [(1000 + i, "small") for i in range(15)] + [(2000 + i, "one") for i in range(8)]
    hot = {r.hash: r.salts for r in D.hot_texts(make(rows).selectExpr("xxhash64(text) AS hash"), len(rows)).collect()}
    assert sorted(hot.values()) == [2, 40]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in D.exact_duplicates(make(rows)).collect()} == brute(rows)
