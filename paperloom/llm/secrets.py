"""Secret scans: fixed patterns, and windows of high entropy in strings of one character class.

Candidate strings are runs of one class's characters.  A window slides over each; the counts of its characters change by one
that leaves and one that comes, and with them the sum of c * log2(c), kept in fixed point, so no window is counted anew.
Windows above the class's entropy join to a span unless the allow-list knows the string.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .hashing import release_memory, text_bytes

# The base patterns, and the characters that what they ask for has at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
#: One of these is in every string that ASSIGN matches, letters in lower case.
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


@dataclass(frozen=True)
class CharClass:
    """Characters of a class, the window's length, and the bits per character from which a window counts."""

    kind: str
    alphabet: str
    window: int
    bits: float


#: Narrow classes first: what they find is not found again by a wider one.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 16, 3.0),
    CharClass("entropy_alnum", "0-9A-Za-z", 20, 3.6),
    CharClass("entropy_base64", "0-9A-Za-z+/=_-", 24, 4.0),
)
#: Strings that are no secrets however varied they are: numbers and dates, words and names joined by signs or by capitals, host names, UUIDs.
ALLOW = (
    r"[0-9+/_.=-]+",
    r"[+/_.=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_.=-]+|$))*",
    r"[a-z]*(?:[A-Z]+[a-z]{2,}|By|Id|In|Is|Of|On|To)*[A-Z]*",
    r"(?:[A-Za-z0-9-]{1,12}\.)+[A-Za-z]{2,10}\.?",
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
)
#: Strings that lie inside one of these, letters in lower case, are no secrets either.
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz0123456789abcdefghijklmnopqrstuvwxyz", "0123456789abcdef" * 2, "qwertyuiopasdfghjklzxcvbnm1234567890")
#: Characters of a token: the widest run that the allow-list is asked about.
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
#: Bytes of text that are looked at at once.
BYTES = 1 << 22
#: Steps of one bit, for sums that do not depend on their order.
_ONE = 1 << 20


class Entropy:
    """Shannon entropy of the last ``window`` characters, by counts."""

    def __init__(self, window: int):
        self.window = window
        cost = [0, *[round(c * math.log2(c) * _ONE) for c in range(1, window + 1)]]
        self.up = [b - a for a, b in zip(cost, cost[1:], strict=False)]  # from c to c + 1

    def least(self, bits: float) -> int:
        """The largest sum of c * log2(c), in steps, at which the entropy is ``bits`` or more."""
        return math.floor((math.log2(self.window) - bits) * self.window * _ONE)

    def high(self, text: str, bits: float) -> Iterator[tuple[int, int]]:
        """Spans of ``text`` that windows of ``bits`` or more cover."""
        counts, total, most, up, window = dict.fromkeys(text, 0), 0, self.least(bits), self.up, self.window
        start = stop = -1
        for i, c in enumerate(text):
            if i >= window:
                old = text[i - window]
                counts[old] -= 1
                total -= up[counts[old]]
            total += up[counts[c]]
            counts[c] += 1
            if i + 1 >= window and total <= most:
                if i + 1 - window > stop:
                    if stop >= 0:
                        yield start, stop
                    start = i + 1 - window
                stop = i + 1
        if stop >= 0:
            yield start, stop


class _Cover:
    """Whether a span lies inside one of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end


@dataclass(frozen=True)
class Scanner:
    classes: tuple[CharClass, ...] = CLASSES
    allow: tuple[str, ...] = ALLOW

    def compiled(self) -> _Compiled:
        return _Compiled(self)


class _Compiled:
    def __init__(self, scanner: Scanner):
        self.classes = [(c, re.compile(f"[{c.alphabet}]{{{c.window},}}"), Entropy(c.window)) for c in scanner.classes]
        self.allow = [re.compile(p) for p in scanner.allow]
        self.least = min([HEX_LEAST, ACCESS_LEAST, *[c.window for c in scanner.classes]])
        self.order = {k: i for i, k in enumerate((*BASE, *[c.kind for c in scanner.classes]))}

    def allowed(self, text: str) -> bool:
        low = text.lower()
        return any(low in s for s in SEQUENCES) or any(p.fullmatch(text) for p in self.allow)

    def spans(self, text: str, tokens: list[tuple[int, int]], assign: bool) -> list[tuple[str, int, int]]:
        """Spans of a text; ``tokens`` are its runs of token characters of ``least`` or more, ``assign`` whether WORDS occur."""
        out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if assign else []
        for a, b in tokens:
            out += [("access", *m.span()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_LEAST]
            out += [("hex", *m.span()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_LEAST]
        found = [(s, e) for _, s, e in out]
        tokens = [x for x in tokens if not self.allowed(text[x[0] : x[1]])]
        for cls, pattern, entropy in self.classes:
            covers, added = _Cover(found), []
            for m in (m for a, b in tokens for m in pattern.finditer(text, a, b)):
                if not self.allowed(m[0]):
                    added += [(m.start() + s, m.start() + e) for s, e in entropy.high(m[0], cls.bits)]
            added = [x for x in added if not covers(*x)]
            found += added
            out += [(cls.kind, *x) for x in added]
        return sorted(out, key=lambda x: (x[1], self.order[x[0]], x[2]))

    def column(self, column: pa.Array) -> list[list[tuple[str, int, int]]]:
        """Spans of each text of a string column, in code points."""
        at, data = text_bytes(column)
        out, i = [], 0
        while i < len(column):
            stop = max(i + 1, int(np.searchsorted(at, at[i] + BYTES, "right")) - 1)
            block = data[at[i] : at[stop]]
            edge = np.diff(np.concatenate(([0], _TOKEN_BYTE[block].view(np.int8), [0])).astype(np.int8))
            cut = at[i:stop] - at[i]  # a token ends with its text
            begin = np.concatenate((np.flatnonzero(edge == 1), cut))
            end = np.concatenate((np.flatnonzero(edge == -1), cut))
            begin, end = np.sort(begin), np.sort(end)
            # at a cut inside a run the sorted ends close it and the sorted begins open it again; elsewhere the pair is empty
            long = end - begin >= self.least
            begin, end = begin[long], end[long]
            first = np.searchsorted(begin, at[i : stop + 1] - at[i])
            for j in range(i, stop):
                raw = data[at[j] : at[j + 1]].tobytes()
                low = raw.lower()
                assign = any(w in low for w in WORDS)
                own = slice(first[j - i], first[j - i + 1])
                if not assign and own.start == own.stop:
                    out.append([])
                    continue
                text, offset = raw.decode("utf-8"), at[j] - at[i]
                runs = [(int(a), int(b)) for a, b in zip(begin[own] - offset, end[own] - offset, strict=True)]
                if len(text) < len(raw) and runs:
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                    runs = [(int(points[a]), int(points[b])) for a, b in runs]
                out.append(self.spans(text, runs, assign))
            i = stop
        return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner = Scanner()) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row: code points, end exclusive, by start, then kind.

    Kinds are assign (the whole assignment), access and hex, which the patterns find, and those of the classes, which the
    windows add; a window's span inside one found before is not added.  Base spans stay whatever the allow-list says.  A
    null or empty text has no spans; rows that repeat an identifier are scanned each; extra columns count for nothing.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = scanner.compiled()
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in ready.column(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])
        release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>")


def op13_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
