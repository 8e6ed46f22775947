import random
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import packing as P
from paperloom.llm.bpe import default_path, vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = default_path("word_bpe_49k.json")


@pytest.mark.parametrize(("n", "seed"), [(0, 0), (1, 1), (50, 2), (3000, 3), (30000, 4)])
def test_plan_holds_every_piece_and_is_tight(n, seed):
    random.seed(seed)
    h = Counter(min(2048, max(1, int(random.lognormvariate(6, 1.2)))) for _ in range(n))
    plan = P.plan(h)
    used = Counter()
    for config, times in plan:
        assert sum(a * k for a, k in config) <= 2048 and times > 0
        for a, k in config:
            used[a] += k * times
    assert used == h
    total = sum(t for _, t in plan)
    least = -(-sum(a * k for a, k in h.items()) // 2048)
    assert total <= least * 1.01 + 2


@pytest.mark.parametrize(("n", "share"), [(300, 0.85), (4000, 0.95)])
def test_pieces_come_from_the_program(n, share):
    random.seed(n)
    h = Counter(min(2047, max(1, int(random.lognormvariate(5.5, 1.3)))) for _ in range(n))
    main, rest = P.solve(h)
    placed = lambda c: sum(k * times for config, times in c.items() for _, k in config)
    assert placed(main) + placed(rest) == n and placed(main) >= share * n
    counts = np.zeros(2049, np.int64)
    counts[list(h)] = list(h.values())
    found = P.program(counts, 2048)
    bound = found.bound
    assert found.gap <= (0.01 if n > 1000 else 0.1)
    covered = np.zeros(2049)
    for config, times in found.used.items():
        assert sum(a * k for a, k in config) <= 2048
        for a, k in config:
            covered[a] += k * times
    assert (covered >= counts - 1e-4).all() and found.total == pytest.approx(sum(found.used.values()))
    volume = sum(a * k for a, k in h.items()) / 2048
    assert volume <= bound + 1e-6 and sum((main + rest).values()) <= bound * 1.01 + 2


def test_bound_is_below_what_pairs_of_long_pieces_need():
    counts = np.zeros(2049, np.int64)
    counts[1100] = 50  # no two fit together
    found = P.program(counts, 2048)
    assert found.bound == pytest.approx(50) and found.total == pytest.approx(50) and sum(P.solve({1100: 50})[0].values()) == 50


def test_all_words_like_the_library_many_texts_at_once():
    c = P.WordIds(vocabulary(PATH))
    random.seed(9)
    texts = ["".join(random.choice("aab's 'll 12 !? éÉ\n\t 日x") for _ in range(random.randint(0, 80))) for _ in range(3000)]
    for t, ids in zip(texts, c.encode_all(texts), strict=True):
        assert ids.tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_ids_like_the_library():
    c = P.WordIds(vocabulary(PATH))
    texts = ["It's a TEST, we'll see 123!", "H̱ ẖ Σ ΑΣ", "a\xa0b C\x1cd", "<|endoftext|> x <|ENDOFTEXT|>", "İ ǅ ﬁ 日本語 ½ 𝐀😀", "é É", "", "\n", "ßẞ ﷺ \u0301x"]
    for t in texts:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces_and_places(spark, make):
    from llm_cases import ODD

    rows = ODD + [(i, "lorem ipsum dolor " * (i % 97)) for i in range(100, 400)]
    out = P.pack_documents(make(rows), PATH).collect()
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in out) // 2048) + 2
    assert P.pack_documents(make([]), PATH).count() == 0


def test_assemble(spark, make):
    docs = make([(1, "one two"), (2, "three"), (3, "four " * 3000)], extra=False)
    seqs = P.assemble(docs, P.pack_documents(docs, PATH), PATH).collect()
    assert sum(len(s.ids) for s in seqs) == sum(len(P.WordIds(vocabulary(PATH)).encode(t)) // 4 + 1 for t in ("one two", "three", "four " * 3000))


def test_characters_of_any_unicode_version_like_the_library():
    from llm_cases import crafted

    c = P.WordIds(vocabulary(PATH))
    random.seed(11)
    planes = [(0x20, 0x3000), (0x3000, 0xD800), (0xE000, 0x10000), (0x10000, 0x20000), (0x20000, 0x32000), (0xE0000, 0x10FFFF)]
    texts = ["".join(chr(random.randint(*random.choice(planes)) if random.random() < 0.7 else ord(random.choice("ab 1'."))) for _ in range(random.randint(1, 12))) for _ in range(10_000)]
    texts = [t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts]
    texts += ["a\u0c5cb", "\U00010ee8\U0001df6d x\U00018ff4b", *[w for k in (10, 11, 12) for w in crafted(k)]]
    want = [x.ids for x in c.tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, ids, w in zip(texts, c.encode_all(texts), want, strict=True) if ids.tolist() != w]
    assert not wrong, (len(wrong), [ascii(t) for t in wrong[:5]])
