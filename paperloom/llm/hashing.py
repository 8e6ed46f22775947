"""Vectorised word and shingle hashing over Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z.  Words are hashed with two
polynomials over byte tables (prefix sums make every word of a buffer one subtraction), one modulo 2^64 and one modulo the
prime 2^31 - 1, as the former alone has equal values for long words by construction; they are mixed with the word's length.
Texts are read in blocks of ``BLOCK`` bytes, so one very long text needs no more working memory than many short ones.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def release_memory() -> None:
    """Gives memory that a task no longer uses back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_BYTE[_SPACE] = 0
_PRIME, _SHIFT = np.uint64((1 << 31) - 1), np.uint64(31)
_P, _PBASE = (1 << 31) - 1, 1_000_000_007
_PBYTE = mix(_LOWER.astype(np.uint64) + np.uint64(512)) % _PRIME
_PBYTE[_SPACE] = 0
_TABLES: dict[str, np.ndarray] = {}


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:  # doubles: base ** (filled + i) = base ** filled * base ** i
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, _P)) % _PRIME
        filled += more
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["pow"] = _powers(_BASE, BLOCK)
        _TABLES["inv"] = _powers(pow(_BASE, -1, 1 << 64), BLOCK)
        _TABLES["prime"] = _prime_powers(_PBASE, BLOCK)
        _TABLES["prime inv"] = _prime_powers(pow(_PBASE, -1, _P), BLOCK)
    return _TABLES["pow"][:n], _TABLES["inv"][:n]


def _raw_words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and both raw polynomials of every run of word bytes in a block of at most BLOCK bytes."""
    edge = np.diff(np.concatenate(([1], _SPACE[block].view(np.int8), [1])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _tables(len(block))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[block] * power, dtype=np.uint64)))
    low = _PBYTE[block] * _TABLES["prime"][: len(block)]
    low = (low & _PRIME) + (low >> _SHIFT)  # the same modulo the prime, below 2^32, so that a block's sum stays below 2^52
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low, dtype=np.uint64)))
    return start, stop - start, (total[stop] - total[start]) * inverse[start], (sums[stop] - sums[start]) % _PRIME * _TABLES["prime inv"][start] % _PRIME


def _finish(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(raw + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _word(raw: np.ndarray, length: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(_finish(raw, length) + low * np.uint64(0xC2B2AE3D27D4EB4F))


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, block by block; a word may span blocks."""
    parts, open_raw, open_len, open_low = [], 0, 0, 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        start, length, raw, low = _raw_words(block)
        if open_len and not (len(start) and start[0] == 0):
            parts.append((np.array([open_raw], np.uint64), np.array([open_len]), np.array([open_low], np.uint64)))
        elif open_len:
            raw[0] = np.uint64((open_raw + int(raw[0]) * pow(_BASE, open_len, 1 << 64)) & _M64)
            low[0] = np.uint64((open_low + int(low[0]) * pow(_PBASE, open_len, _P)) % _P)
            length[0] += open_len
        open_raw = open_len = open_low = 0
        if len(start) and not _SPACE[block[-1]]:
            open_raw, open_len, open_low = int(raw[-1]), int(length[-1]), int(low[-1])
            raw, length, low = raw[:-1], length[:-1], low[:-1]
        parts.append((raw, length, low))
    if open_len:
        parts.append((np.array([open_raw], np.uint64), np.array([open_len]), np.array([open_low], np.uint64)))
    return _word(*map(np.concatenate, zip(*parts, strict=True))) if parts else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _joined(column: pa.Array) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
    """Groups of consecutive texts: index of the first, their ends, and their bytes with a space after each text.

    A text of half a block or more comes alone, without ends and as it is.
    """
    at, data = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        if at[i + 1] - at[i] >= BLOCK // 2:
            yield i, None, data[at[i] : at[i + 1]]
            i += 1
            continue
        stop = int(np.searchsorted(at[i + 1 :] + np.arange(1, n - i + 1), at[i] + BLOCK - 1, "right")) + i
        stop = max(stop, i + 1)
        long = np.flatnonzero(np.diff(at[i : stop + 1]) >= BLOCK // 2)
        stop = i + int(long[0]) if len(long) else stop
        ends = at[i + 1 : stop + 1] - at[i]
        yield i, ends + np.arange(1, stop - i + 1), np.insert(data[at[i] : at[stop]], ends, np.uint8(0x20))
        i = stop


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts: index of the first, words in each text, and all their word hashes in order."""
    for i, ends, data in _joined(column):
        if ends is None:
            words = _long_words(data)
            yield i, np.array([len(words)]), words
        else:
            start, length, raw, low = _raw_words(data)
            owner = np.searchsorted(ends, start, "right")
            yield i, np.bincount(owner, minlength=len(ends)), _word(raw, length, low)


def word_cues(column: pa.Array, prefixes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``word_hashes``, with one column for the word and one for its first k bytes, k in ``prefixes``.

    A word no longer than k has its own hash there.  Long texts are read in blocks that end at white space; a run of a
    whole block without any is cut there.
    """
    for i, ends, data in _joined(column):
        blocks, at = [], 0
        while at < len(data):
            stop = min(at + BLOCK, len(data))
            if stop < len(data):
                spaces = np.flatnonzero(_SPACE[data[at:stop]])
                stop = at + int(spaces[-1]) + 1 if len(spaces) else stop
            blocks.append((at, data[at:stop]))
            at = stop
        counts = np.zeros(1 if ends is None else len(ends), np.int64)
        out = [np.zeros((0, 1 + len(prefixes)), np.uint64)]
        for at, block in blocks:
            edge = np.diff(np.concatenate(([1], _SPACE[block].view(np.int8), [1])).astype(np.int8))
            start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            power, inverse = _tables(len(block))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[block] * power, dtype=np.uint64)))
            cues = np.empty((len(start), 1 + len(prefixes)), np.uint64)
            for j, k in enumerate((len(block), *prefixes)):
                end = np.minimum(stop, start + k)
                cues[:, j] = _finish((total[end] - total[start]) * inverse[start], end - start)
            out.append(cues)
            counts += len(start) if ends is None else np.bincount(np.searchsorted(ends, start + at, "right"), minlength=len(ends))
        yield i, counts, np.concatenate(out)


def shingles(counts: np.ndarray, words: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += mix(words[j:] + np.uint64((j * 0xA0761D6478BD642F) & _M64)) * np.uint64(2 * j + 3)
    rolled = mix(rolled)
    at = 0
    for c in counts.tolist():
        if c >= k:
            own = np.sort(rolled[at : at + c - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif c:
            short = sum(int(mix(words[at + j : at + j + 1] + np.uint64(c + 11))[0]) * (2 * j + 5) for j in range(c))
            yield mix(np.array([short & _M64], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c


def text_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """``shingles`` of every text of a column, in its order."""
    for _, counts, words in word_hashes(column):
        yield from shingles(counts, words, k)
