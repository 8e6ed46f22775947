from paperloom.llm.line_dedup import drop_repeated_lines


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_like_brute_force(spark, make):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "q\nq\nq\nq\nq"), (5, "one\ntwo"), (6, ""), (7, "a\nb\nc\nd"), (8, "\n\n\n\n"), (9, "p\na\nb\nc\nd\ne\na\nb\nc")]
    got = {r.doc_id: r.text for r in drop_repeated_lines(make(rows)).collect()}
    assert got == brute(rows)
    assert got[7] == "" and got[5] == "one\ntwo" and got[8] == "\n\n\n\n"


def test_columns_nulls_repeats(spark, make):
    docs = make([(1, None), (2, "a\nb\nc"), (2, "a\nb\nc"), (2, "z\na\nb\nc"), (None, "a\nb\nc")])
    out = drop_repeated_lines(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = sorted((str(r.doc_id), r.text or "null", r.n_removed) for r in out.collect())
    # rows that repeat an identifier with the same text are one document
    kept = [x for x in got if x[0] == "2" and x[2] == 0]
    assert ("1", "null", 0) in got and ("None", "null", 0) not in got and len(kept) in (1, 2) and len(got) == 5
    assert drop_repeated_lines(make([])).count() == 0


def test_long_text(spark, make):
    text = "\n".join(str(k % 7) for k in range(30000))
    got = {r.doc_id: r.text for r in drop_repeated_lines(make([(1, text), (2, "unique\nlines\nhere")])).collect()}
    assert got == brute([(1, text), (2, "unique\nlines\nhere")])
