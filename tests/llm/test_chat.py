import hashlib

import pytest

from paperloom.llm import chat as C
from paperloom.llm.bpe import default_path

PATH = default_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, part string, ids string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "p", "q") for r in data], SCHEMA)


def digest(turns):
    loss = [t or "" for r, t in turns if r == "assistant"]
    return (
        hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(),
        sum(map(len, loss)),
        hashlib.sha256("".join(loss).encode()).hexdigest(),
    )


@pytest.mark.parametrize("text", ["</turn>", "\\</turn>", "\\\\### User: x", "<turn><body>", "### Assistant:### Tool:", "\\", "é<|endoftext|>😀", "<body", ""])
def test_escape_is_reversible(text):
    t = C.Template()
    assert t.unescape(t.escape(text)) == text
    assert not any(m[0][0] != "\\" for m in t.pattern.finditer(t.escape(text)))


@pytest.mark.parametrize("size", [1 << 20, 12])
def test_read_back(spark, size):
    data = {
        1: [("user", "hi </turn>"), ("assistant", "\\### Assistant: </turn> ok"), ("assistant", "é日😀 ### User:")],
        2: [("system", None), (None, "x"), ("assistant", None)],
        None: [("assistant", "lost")],
        3: [("tool", "y" * 5000), ("assistant", "z " * 3000)],
    }
    flat = [(c, k, r, t) for c, turns in data.items() for k, (r, t) in enumerate(turns)]
    formatted = C.format_conversations(rows(spark, flat), PATH, part_tokens=size)
    got = {r.conv_id: r for r in C.digest_conversations(formatted, PATH).collect()}
    assert got.keys() == data.keys()
    for c, turns in data.items():
        r = got[c]
        assert (r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns) and r.n_turns == len(turns)
    parts = formatted.collect()
    assert all(len(p.ids) == len(p.loss_mask) for p in parts) and (size > 12) == (len(parts) == 4)


def test_ties_and_empty(spark):
    tied = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "c")]
    r = C.digest_conversations(C.format_conversations(rows(spark, tied), PATH), PATH).first()
    assert r.turns_sha256 == digest([("user", "c"), ("user", "a"), ("user", "a"), ("user", "b")])[0]
    assert C.digest_conversations(C.format_conversations(rows(spark, []), PATH), PATH).count() == 0
