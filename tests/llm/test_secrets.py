import base64
import math
import random
import re
from collections import Counter

import pyarrow as pa
from llm_cases import ODD

from paperloom.llm import secrets as S

ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    """The base spans by plain searches over the whole text."""
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], S.BASE.index(x[0]), x[2]))


def windows(text, cls):
    """Spans of high windows, each window counted anew."""
    covered = [False] * len(text)
    for i in range(len(text) - cls.window + 1):
        counts = Counter(text[i : i + cls.window]).values()
        if -sum(c / cls.window * math.log2(c / cls.window) for c in counts) >= cls.bits - 1e-9:
            covered[i : i + cls.window] = [True] * cls.window
    return [m.span() for m in re.finditer("1+", "".join("01"[c] for c in covered))]


def texts(rng, n=400):
    parts = ["password = ", "Token:", "SECRET='", "api_key=", "apikey: ", "passwd", "AKIA", " ", "\n", "é", "𝒳", "ſecret=", "toKen=", '"', "word", "a.b@c.de", ": "]
    chars = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_.-"]
    for _ in range(n):
        yield "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choices(rng.choice(chars), k=rng.randint(1, 40))) for _ in range(rng.randint(0, 12)))


def found(text):
    return S.Scanner().compiled().column(pa.array([text]))[0]


def test_base_spans_like_plain_searches():
    rows = [*texts(random.Random(1)), "token=secret: abcdefghijklmnop", "token=password=abcdefghijkl", "to\u212aen=abcdefghijklmnop", "AKIA" * 9, "x" * 30 + "0" * 16]
    got = S.Scanner().compiled().column(pa.array(rows))
    for text, spans in zip(rows, got, strict=True):
        assert [s for s in spans if s[0] in S.BASE] == base(text)
        assert spans == found(text) and all(0 <= s < e <= len(text) for _, s, e in spans)


def test_incremental_entropy_equals_counting_anew():
    rng = random.Random(2)
    for cls in S.CLASSES:
        for k in range(60):
            text = "".join(rng.choices("0123456789abcdef" if k % 2 else "abcdefgh0123456789XYZ+/", weights=None, k=rng.randint(1, 120)))
            assert list(S.Entropy(cls.window).high(text, cls.bits)) == windows(text, cls)


def test_added_spans_and_allow_list():
    rng = random.Random(3)
    random_keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(200)]
    hits = sum(any(s[0].startswith("entropy") for s in found(f"key {k} end")) for k in random_keys)
    assert hits >= 190
    assert any(s[0] == "entropy_hex" for s in found("A1B2C3D4E5F60718293A"))
    for clean in ["2024-10-11/2025-01-31/12.30", "a/path/to/some/module_name/file_name.txt", "getElementsByTagNameAndClassName", "mail8.example.com.subdomain.org", "123e4567-e89b-12d3-a456-42661417400a", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdefABCDEFG"[:16].upper(), "ONESESTIONERREINGENUND", "=" * 500, "Donaudampfschifffahrtsgesellschaft"]:
        assert not [s for s in found(f"x {clean} y") if s[0].startswith("entropy")], clean
    # base spans stay although the allow-list knows the string
    assert [s[0] for s in found("4111111111111111")] == ["hex"]
    # nothing is found twice
    text = "token = '" + random_keys[0].replace("+", "A").replace("/", "B") + "'"
    assert [s[0] for s in found(text)] == ["assign"]
    assert S.Scanner(allow=(".*",)).compiled().column(pa.array(["k " + random_keys[0]])) == [[]]


def test_long_texts_stay_linear():
    rng = random.Random(4)
    blob = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=300_000))
    assert len(found(blob)) < 10 and found(blob)[-1][2] > 299_000
    assert found("token" + " " * 300_000) == [] and found("-" * 300_000 + "x1") == [] and found("z" * 300_000 + "1") == []


def test_rows(spark, make):
    rows = [*ODD, (8, "AKIA" + "A" * 14), (8, "AKIA" + "A" * 14), (9, "é password: hunter2hunter2 é")]
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in S.scan_secrets(make(rows)).collect())
    assert got == sorted((str(i), found(t or "")) for i, t in rows)
    assert [tuple(s) for s in S.scan_secrets(make([(9, rows[-1][1])])).first().spans] == [("assign", 2, 26)]
    assert S.scan_secrets(make([])).count() == 0


def test_query(spark):
    rows = {r.doc_id: r for r in S.op13_secrets(spark, "/root/testdata/sf0.001").collect()}
    import hashlib

    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want = base(r.text or "")
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (rows[r.doc_id].n_assign, rows[r.doc_id].n_access, rows[r.doc_id].n_hex) == tuple(sum(s[0] == k for s in want) for k in S.BASE)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(rows[r.doc_id].spans.split(","))
