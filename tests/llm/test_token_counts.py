import numpy as np
import pytest

from paperloom.llm import token_counts as T
from paperloom.llm.bpe import compiled, default_path, vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = default_path("byte_bpe_50k.json")
TEXTS = ["one two\nthree 日本語😀 four\n\nfive", "", "\n\n", "a\nb", "é" * 50 + "\n" + "x" * 70, "<|endoftext|>q\nr"]


def brute(text, sections, rule):
    known = tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    a, e = T.token_spans(compiled(vocabulary(PATH)), text, np.array(known.ids, "<u4"))
    assert known.offsets == list(zip(a.tolist(), e.tolist(), strict=True))
    out = dict.fromkeys([-1, *range(len(sections))], 0)
    for s, t in zip(a.tolist(), e.tolist(), strict=True):
        over = [max(0, min(t, q) - max(s, p)) for p, q in sections]
        hit = [i for i, n in enumerate(over) if n]
        out[-1 if not hit else hit[0] if rule == "first" else hit[-1] if rule == "last" else max(hit, key=lambda i: (over[i], -i))] += 1
    return out


@pytest.mark.parametrize("rule", T.RULES)
def test_given_sections_like_brute_force(spark, make, rule):
    cuts = {i: [(k, min(k + 3, len(t))) for k in range(0, len(t), 3) if k % 2 == 0 or k > 5] for i, t in enumerate(TEXTS)}
    sections = spark.createDataFrame([(i, k, a, b) for i, own in cuts.items() for k, (a, b) in enumerate(own)] + [(0, None, 1, 2), (99, 0, 0, 5)], "doc_id long, section long, start long, stop long")
    got = T.count_tokens(make(list(enumerate(TEXTS))), PATH, sections=sections, rule=rule).collect()
    for i, t in enumerate(TEXTS):
        assert {r.section: r.n_tokens for r in got if r.doc_id == i} == brute(t, cuts[i], rule)


def test_lines_and_odd_rows(spark, make):
    from llm_cases import ODD

    got = T.count_tokens(make(ODD), PATH).collect()
    assert sum(r.section == -1 for r in got) == len(ODD)
    whole = {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
    bpe = compiled(vocabulary(PATH))
    assert whole[7] == len(bpe.encode("word " * 30000)) // 4 and whole[1] == 0
    assert T.count_tokens(make([]), PATH).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(make([]), PATH, rule="none")


def test_overlapping_sections():
    names, starts, stops = T._disjoint([(1, 0, 5), (2, 3, 8), (3, 4, 5)])
    assert names.tolist() == [1, 2] and starts.tolist() == [0, 5] and stops.tolist() == [5, 8]
    assert T.allocate(np.array([0, 4]), np.array([4, 7]), starts, stops, "most").tolist() == [0, 1]


@pytest.mark.parametrize("rule", T.RULES)
def test_every_given_section_has_a_row(spark, make, rule):
    text = "one two three four five six seven"
    given = [(1, 0, 18), (2, 4, 7), (2, 4, 7), (3, 14, 23), (4, 0, 18), (5, 20, 400), (6, -3, 2)]
    sections = spark.createDataFrame([(0, *g) for g in given], "doc_id long, section long, start long, stop long")
    got = T.count_tokens(make([(0, text)]), PATH, sections=sections, rule=rule).collect()
    assert sorted((r.section, r.start, r.stop) for r in got) == sorted([(-1, 0, len(text)), *((n, max(a, 0), min(b, len(text))) for n, a, b in given)])
    assert sum(r.n_tokens for r in got) == len(compiled(vocabulary(PATH)).encode(text)) // 4
    count = {r.section: r.n_tokens for r in got}
    assert count[2] == count[4] == 0 and count[1] > 0 and count[-1] == 0
