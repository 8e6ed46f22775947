"""Words of texts as arrays: splitting by character classes, and a table of the ids of words seen before.

Many texts are read at once as one array of code points.  Words begin where the class of characters changes (letters,
numbers, white space, all else) and are hashed with prefix sums of a polynomial, so no Python object is made for a word
unless it is new to the table.  A hash only says where to look: a word is that of the table if all its letters are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from .hashing import mix

# Fixed values of the byte-level format: white space as its splitter sees it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # the inside of a character class
LETTER, NUMBER, SPACE = 1, 2, 3
#: Characters read at once, and characters of words that a table holds.
BLOCK = 1 << 19
LETTERS = 1 << 24
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def classes() -> np.ndarray:
    """The class of every code point, LETTER, NUMBER, SPACE or 0, as the patterns of the tokenizers library have it."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(0x110000, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x40000)))  # no plane above has letters, numbers or spaces
    every = "".join(map(chr, points.tolist()))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[points[a:b]] = kind
    for m in re.finditer(f"[{WHITE}]", every):
        out[points[m.start()]] = SPACE
    return out


@cache
def _values() -> np.ndarray:
    return mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, BLOCK), base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def hashes(points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, stop), never 0."""
    up, down = _powers(len(points))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values()[points] * up, dtype=np.uint64)))
    out = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(out == 0, np.uint64(1), out)


def split(points: np.ndarray, bounds: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every word of texts that lie one after the other and begin at ``bounds``.

    Both forms know the English endings 's 't 're 've 'm 'll 'd.  With ``spaced`` (byte-level) a space belongs to the word
    after it, white space before other text gives its last character away and numbers are runs; else white space is no
    word and each digit is one.
    """
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 2, bool)
    first[bounds] = first[n:] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    if spaced:
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
        new[last] = True
        new[last[points[last] == 0x20] + 1] = False
    else:
        new |= kind == NUMBER
    tick = np.flatnonzero((points == 0x27) & new)
    if len(tick):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        a, b = padded[tick + 1], padded[tick + 2]
        near = ~first[tick + 1]
        one = near & np.isin(a, [ord(c) for c in "stmd"])
        two = near & ~first[tick + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        new[tick[one | two] + 1] = False
        after = np.concatenate((tick[one] + 2, tick[two] + 3))
        new[after[after < n]] = True
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n)
    return (start, stop) if spaced else (start[(some := ~white[start])], stop[some])


def groups(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of consecutive texts, BLOCK characters at a time: the index of each part's text, and the parts.

    Long texts are cut where white space follows something else, which no word crosses; an unbroken run is one part.
    """
    owner, parts, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > BLOCK:
                stop = _cut(text, at, at + BLOCK)
            if parts and held + stop - at > BLOCK:
                yield owner, parts
                owner, parts, held = [], [], 0
            owner.append(i), parts.append(text[at:stop])
            held += stop - at
            at = stop
            if at >= len(text):
                break
    if parts:
        yield owner, parts


def _cut(text: str, at: int, most: int) -> int:
    """The last place up to ``most`` where white space follows something else, or the first one after it."""
    known = classes()
    white = known[code_points(text[at:most])] == SPACE
    ok = np.flatnonzero(white[1:] & ~white[:-1])
    if len(ok):
        return at + int(ok[-1]) + 1
    while most < len(text):
        white = known[code_points(text[most - 1 : most + BLOCK])] == SPACE
        ok = np.flatnonzero(white[1:] & ~white[:-1])
        if len(ok):
            return most + int(ok[0])
        most += BLOCK
    return len(text)


class WordTable:
    """Ids of words, an open-addressing table in arrays: the hash of a word, its letters and its ids.

    ``learn`` gives the ids of a list of new words, one after the other, and how many each has (or None where it cannot).
    A table that is half full, or that holds LETTERS letters, starts anew, so memory stays bounded; what is kept changes the
    time and not the ids.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None], slots: int = 1 << 20) -> None:
        self.learn, self.slots = learn, slots
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at, self.n = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.word_at, self.size = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int64)
        self.pool, self.used, self.held = np.zeros(1 << 16, "<u4"), 0, 0
        self.letters, self.lettered = np.zeros(1 << 16, "<u4"), 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and whether it is there (else the slot is empty)."""
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        found = self.keys[slot]
        there = found == h
        rest = np.flatnonzero(~there & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (self.slots - 1)
            found = self.keys[slot[rest]]
            there[rest] = found == h[rest]
            rest = rest[(found != h[rest]) & (found != 0)]
        return slot, there

    def _add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        letters = points[_stretches(start, size)]
        self.pool, self.letters = _grown(self.pool, self.used + len(ids)), _grown(self.letters, self.lettered + len(letters))
        self.pool[self.used : self.used + len(ids)] = ids
        self.letters[self.lettered : self.lettered + len(letters)] = letters
        at, word_at = self.used + np.cumsum(n) - n, self.lettered + np.cumsum(size) - size
        self.used, self.lettered = self.used + len(ids), self.lettered + len(letters)
        left = np.arange(len(h))
        while len(left):
            slot, _ = self._find(h[left])
            self.keys[slot] = h[left]
            won = self.keys[slot] == h[left]
            own = left[won]
            self.at[slot[won]], self.n[slot[won]], self.word_at[slot[won]], self.size[slot[won]] = at[own], n[own], word_at[own], size[own]
            left = left[~won]
        self.held += len(h)

    def _same(self, slot: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the word of each slot is the one asked for, letter by letter."""
        same = self.size[slot] == size
        rows = np.flatnonzero(same)
        if not len(rows):
            return same
        n = size[rows]
        ends = np.cumsum(n)
        first, last = start[rows[0]], start[rows[-1]] + n[-1]
        own = points[first:last] if last - first == ends[-1] else points[_stretches(start[rows], n)]
        differ = np.flatnonzero(self.letters[_stretches(self.word_at[slot[rows]], n)] != own)
        same[rows[np.searchsorted(ends, differ, "right")]] = False
        return same

    def ids(self, text: str, points: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of the words of ``text`` in order, and how many each word has; None where one cannot be learned."""
        size = stop - start
        slot, there = self._find(h)
        if not there.all():
            own, where = np.unique(h[~there], return_index=True)
            where = np.flatnonzero(~there)[where]
            if self.held + len(own) > self.slots // 2 or self.lettered + size[where].sum() > LETTERS:
                self._clear()
                own, where = np.unique(h, return_index=True)
                if len(own) > self.slots // 2:
                    self.slots = 1 << (2 * len(own)).bit_length()
                    self._clear()
            got = self.learn([text[a:b] for a, b in zip(start[where].tolist(), stop[where].tolist(), strict=True)])
            if got is None:
                return None
            self._add(own, *got, points, start[where], size[where])
            slot, _ = self._find(h)
        at, n, pool = self.at[slot], self.n[slot].astype(np.int64), self.pool
        other = np.flatnonzero(~self._same(slot, points, start, size))
        if len(other):  # words with the hash of another word are learned for this time only
            words = [text[a:b] for a, b in zip(start[other].tolist(), stop[other].tolist(), strict=True)]
            place = {w: i for i, w in enumerate(dict.fromkeys(words))}
            got = self.learn(list(place))
            if got is None:
                return None
            rows = np.array([place[w] for w in words])
            at[other], n[other] = self.used + (np.cumsum(got[1]) - got[1])[rows], got[1][rows]
            pool = np.concatenate((pool[: self.used], got[0]))
        return pool[_stretches(at, n)], n


def _grown(array: np.ndarray, least: int) -> np.ndarray:
    return array if least <= len(array) else np.concatenate((array, np.zeros(max(len(array), least - len(array)), array.dtype)))


def _stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of stretches of n, one stretch after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_texts(texts: list[str], table: WordTable, spaced: bool, whole: Callable[[str], np.ndarray]) -> Iterator[np.ndarray]:
    """The ids of every text in order; ``whole`` encodes parts with words that the table cannot learn."""
    done: list[np.ndarray] = []
    current = 0
    for owner, parts in groups(texts):
        text = "".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        bounds = np.cumsum(sizes) - sizes
        got = None
        if text:
            points = code_points(text)
            start, stop = split(points, bounds[sizes > 0], spaced)
            got = table.ids(text, points, hashes(points, start, stop), start, stop)
        if text and got is None:
            own = [whole(p) for p in parts]
        elif text:
            ids, n = got
            before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            cuts = before[np.searchsorted(start, np.append(bounds, len(points)), "left")]
            own = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        else:
            own = [np.zeros(0, "<u4")] * len(parts)
        for i, piece in zip(owner, own, strict=True):
            if i != current:
                yield done[0] if len(done) == 1 else np.concatenate(done)
                done, current = [], i
            done.append(piece)
    if done:
        yield done[0] if len(done) == 1 else np.concatenate(done)
