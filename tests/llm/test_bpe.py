import random

import numpy as np
import pytest

from paperloom.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")
PATH = B.default_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return B.ByteBpe(B.vocabulary(PATH)), tokenizers.Tokenizer.from_file(PATH)


def ids(bpe, text):
    return np.frombuffer(bpe.encode(text), "<u4").tolist()


def test_like_the_library(both):
    bpe, lib = both
    random.seed(5)
    letters = "aaabcdehinot  '\n\t.,\xa0é日😀019--"
    texts = ["", " ", "it's  we'll\n\n x", "<|endoftext|>a<|endoftext|>", "a" * 999, " " * 300, "日本語" * 50, "é" * 999]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert ids(bpe, t) == lib.encode(t, add_special_tokens=False).ids, t[:40]
        assert bpe.decode(bpe.encode(t)).decode() == t


def test_many_texts_at_once(both, monkeypatch):
    from paperloom.llm import words as W

    bpe, lib = both
    random.seed(6)
    texts = ["".join(random.choice("abcdefgh'stll \n.é日1") for _ in range(random.randint(0, 90))) for _ in range(500)]
    texts += ["x" * 5000, " ".join(["lorem"] * 3000), "", "q<|endoftext|> r"]
    want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode_all(texts)] == want
    # small blocks cut long texts, a small table starts anew again and again
    monkeypatch.setattr(W, "BLOCK", 64)
    bpe.words = W.WordTable(bpe.words.learn, 256)
    assert [x.tolist() for x in bpe.encode_all(texts)] == want


def test_table_is_that_of_the_gadgets(both):
    # the transition table against whether two tokens are their own encoding, for random pairs
    bpe, lib = both
    m = bpe.automaton
    random.seed(7)
    arcs = list(m.arcs.values())
    pairs = [(a, b) for a, b in ((random.choice(arcs), random.choice(arcs)) for _ in range(4000))]
    got = m.allows(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist()
    assert got == [m.encode(m.labels[a] + m.labels[b]) == [a, b] for a, b in pairs]


def test_automaton_accepts_only_what_merges_give():
    # aab -> merges (a, a), (aa, b): "aaab" is aa + ab, never a + aab
    labels = [b"a", b"b", b"aa", b"ab", b"aab"]
    m = B.MergeAutomaton(labels, [0, 1], [(0, 0, 2), (0, 1, 3), (2, 1, 4)])
    assert m.encode(b"aaab") == [2, 3] and m.encode(b"aab") == [4] and m.encode(b"aaaa") == [2, 2]
    assert not m.allows(0, 0) and not m.allows(2, 1) and m.allows(2, 0)


def test_rows(spark, make):
    from llm_cases import ODD

    docs = make(ODD)
    out = B.encode_documents(docs, PATH, digests=True)
    rows = out.collect()
    assert len(rows) == len(ODD) and sum(r.n_tokens == 0 for r in rows) == 2
    back = sorted((str(r.doc_id), r.text) for r in B.decode_documents(out, PATH).collect())
    assert back == sorted((str(i), t or "") for i, t in ODD)
    assert B.encode_documents(make([]), PATH).count() == 0


def test_words_with_equal_hashes_keep_their_own_ids(both, spark, make):
    from llm_cases import crafted

    bpe, lib = both
    texts = [w for k in (10, 11, 12) for w in crafted(k)] * 2 + ["a b " + " ".join(crafted(11))]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bpe.encode_all(texts)] == want
    assert [x.tolist() for x in bpe.encode_all(texts)] == want  # now the table knows one of each pair
    assert [bpe.decode(x).decode() for x in bpe.encode_all(texts)] == texts
    rows = B.encode_documents(make(list(enumerate(texts))), PATH).collect()
    assert {r.doc_id: r.ids for r in rows} == dict(enumerate(want))


def test_every_word_in_one_slot(both, monkeypatch):
    from paperloom.llm import words as W

    bpe, lib = both
    random.seed(8)
    texts = ["".join(random.choice("abc d.") for _ in range(60)) for _ in range(40)]
    monkeypatch.setattr(W, "hashes", lambda points, start, stop: np.full(len(start), 5, np.uint64))
    table = W.WordTable(bpe.words.learn, 256)
    got = list(W.encode_texts(texts, table, True, lambda part: part))
    assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
