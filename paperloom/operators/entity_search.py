"""The search of the entity rules over many texts at once, and the tests of what they find, for plain strings.

Texts are joined with a character that no pattern matches, so a rule passes once over all of them.  A rule whose matches begin
with a run of characters is not tried at each of them: its rarer part is looked for, and the match begins where the run before
it begins, where the last match ended, or as many characters before as the run may have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Between texts; no class of a pattern has it.
GAP = "\0"
#: Texts are joined up to this many characters.
JOINED = 1 << 18


def any_of(words: tuple[str, ...] | list[str]) -> str:
    """A pattern that finds every place of the words, also where they overlap: it takes their first character alone."""
    return "|".join(re.escape(w[0]) + (f"(?={re.escape(w[1:])})" if w[1:] else "") for w in words)


@dataclass(frozen=True)
class Anchor:
    """A part that each match of a rule has right after its first run: a pattern of one character that finds all its places.

    ``run`` are the characters of the run, at least ``least`` and at most ``most``.  With ``spaces`` white space may stand
    between the run and the part.  ``last``: the part ends the match, and its beginning is searched for from where the run begins.
    """

    pattern: str
    run: str
    least: int = 1
    most: int | None = None
    spaces: bool = False
    last: bool = False


class _Inside(dict):
    """Whether a character is in a class, asked once for each character."""

    def __init__(self, chars: str):
        super().__init__()
        self.match = re.compile(f"[{chars}]").match

    def __missing__(self, c: str) -> bool:
        self[c] = self.match(c) is not None
        return self[c]


Search = Callable[[str], Iterator[tuple[int, str]]]


def search(pattern: str, anchor: Anchor | None = None, group: int = 1) -> Search:
    """A function that gives (place, value) of all matches in a text, those that the pattern alone finds from left to right."""
    whole = re.compile(pattern, re.ASCII)
    if anchor is None:
        return lambda text: ((m.start(), m[group]) for m in whole.finditer(text))
    part, inside, white = re.compile(anchor.pattern, re.ASCII), _Inside(anchor.run), " \n\t\r\x0b\f"
    least, most, spaces, last = anchor.least, anchor.most, anchor.spaces, anchor.last

    def found(text: str) -> Iterator[tuple[int, str]]:
        upto = 0
        for hit in part.finditer(text):
            end = hit.start()
            if end < upto + least:
                continue
            if spaces:
                while end > upto and text[end - 1] in white:
                    end -= 1
            begin, low = end, upto if most is None else max(upto, end - most)
            while begin > low and inside[text[begin - 1]]:
                begin -= 1
            if end - begin < least:
                continue
            m = whole.search(text, begin, hit.end()) if last else whole.match(text, begin)
            if m:
                yield m.start(), m[group]
                upto = m.end()

    return found


def search_texts(texts: list[str | None], kinds: list[tuple[str, list[Search], Callable[[str], str | None]]]) -> pa.StringArray:
    """For each text its distinct entities as "type value" with GAP between them, null without any.

    ``kinds`` are types, their searches, and what makes a value of what these find, or null.
    """
    found: list[dict[str, None]] = [{} for _ in texts]
    at, n = 0, len(texts)
    while at < n:
        begins, size, first = [], 0, at
        while at < n and (at == first or size < JOINED):
            begins.append(size)
            size += len(texts[at] or "") + 1
            at += 1
        joined, begins = GAP.join([t or "" for t in texts[first:at]]), np.array(begins)
        for kind, searches, value in kinds:
            hits = [hit for search in searches for hit in search(joined)]
            if hits:
                places, raws = zip(*hits, strict=True)
                own = np.searchsorted(begins, np.array(places), "right") + (first - 1)
                for i, raw in dict.fromkeys(zip(own.tolist(), raws, strict=True)):
                    if (v := value(raw)) is not None:
                        found[i][f"{kind} {v}"] = None
    return pa.array([GAP.join(own) if own else None for own in found], pa.string())
