"""Byte-level BPE as a token automaton: encoding by table-driven transitions, decoding by emitting arc labels.

``MergeAutomaton`` is compiled from the merge list by one gadget per merge.  At first there is one state with an arc for
every byte.  The gadget of merge (u, v) -> w looks at the state that u leads to: if v may follow there, then

* w gets an arc wherever u has one, and leads where v leads;
* u from now on leads to a copy of its state without the arc v.

What is left accepts exactly the token sequences that the merges produce, one path for each word, and so one for each
beginning of a word.  There is one state per token.  Arcs are numbered so that v and what was made of v after a given merge
have consecutive numbers; so each removal is one interval, and the whole transition table is, for each state, the sorted
intervals of arcs that it lacks.  It is complete before the first word is read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import WordTable, encode_texts

#: Bytes of a word up to which words are encoded many at once.
SHORT = 64


def byte_letters() -> dict[str, int]:
    """The letter of each byte in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """labels: bytes of each token; single: token of each byte; merges: (u, v, w) in order of priority."""

    def __init__(self, labels: list[bytes], single: list[int], merges: list[tuple[int, int, int]]) -> None:
        self.labels, self.size = labels, len(labels)
        self.lengths = np.array([len(x) for x in labels], np.int64)
        self.start = np.array(single, np.int64)
        left, right, born = ([-1] * self.size for _ in range(3))
        cut: dict[int, int] = {}
        for k, (u, v, w) in enumerate(merges, 1):
            if _removed(cut, self.size, left, right, born, u, v):
                continue  # v may not follow u, so this merge never happens
            if born[w] >= 0:
                raise ValueError(f"two merges make token {w}")
            cut[u * self.size + v] = k
            left[w], right[w], born[w] = u, v, k
        left, right, born = (np.array(x, np.int64) for x in (left, right, born))
        arcs = [*single, *np.flatnonzero(born >= 0).tolist()]
        self.arcs: dict[bytes, int] = {labels[t]: t for t in arcs}
        self.longest = max(len(x) for x in self.arcs)
        #: Arcs by number, and the intervals that states lack: ``lacks`` <= key < ``until`` for key = state * size + number.
        self.number = np.full(self.size, -1, np.int64)
        self.lacks, self.until = self._table(cut, left, right, born, np.array(arcs, np.int64))
        self._labels = _LabelTable(labels, arcs)

    def _table(self, cut: dict[int, int], left: np.ndarray, right: np.ndarray, born: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of lacking arcs of all states as sorted keys state * size + number, first and one past the last."""
        size = self.size
        children: dict[int, list[int]] = {}
        for w in sorted(np.flatnonzero(born >= 0).tolist(), key=born.__getitem__):
            children.setdefault(int(left[w]), []).append(w)
        past, n = np.zeros(size, np.int64), 0
        stack = [(int(t), True) for t in self.start]
        while stack:
            t, enter = stack.pop()
            if not enter:
                past[t] = n
                continue
            self.number[t] = n
            n += 1
            stack.append((t, False))
            stack += [(c, True) for c in children.get(t, ())]  # those made last come first
        owner, arc, when = (np.array(x, np.int64) for x in ([k // size for k in cut], [k % size for k in cut], list(cut.values())))
        stop = self.number[arc] + 1
        for i, (v, k) in enumerate(zip(arc.tolist(), when.tolist(), strict=True)):
            after = next((c for c in children.get(v, ()) if born[c] >= k), None)  # the first child made after the removal
            if after is not None:
                stop[i] = past[after]
        span = len(cut) + 2
        order = np.argsort(owner * span + when)
        key, first, stop = (owner * span + when)[order], self.number[arc][order], stop[order]
        # a state has the removals of its token, those of the token's right part before the token was made, and so on
        states, firsts, stops = [], [], []
        state, at, before = arcs, arcs, np.full(len(arcs), span - 1)
        while len(state):
            low, high = np.searchsorted(key, at * span), np.searchsorted(key, at * span + before)
            count = high - low
            ends = np.cumsum(count)
            rows = np.repeat(low - (ends - count), count) + np.arange(int(ends[-1]))
            states.append(np.repeat(state, count)), firsts.append(first[rows]), stops.append(stop[rows])
            more = right[at] >= 0
            state, at, before = state[more], right[at[more]], born[at[more]]
        states, firsts, stops = map(np.concatenate, (states, firsts, stops))
        order = np.lexsort((-stops, firsts, states))
        lacks, until = (states * size + firsts)[order], (states * size + stops)[order]
        top = np.maximum.accumulate(until)
        first = np.flatnonzero(np.concatenate(([True], lacks[1:] > top[:-1])))  # others lie within or next to those before
        return lacks[first], np.maximum.reduceat(until, first)

    def allows(self, states: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Whether each state has the arc: one search in the table."""
        q = states * self.size + self.number[arcs]
        i = np.searchsorted(self.lacks, q, "right") - 1
        return (i < 0) | (q >= self.until[i])

    def encode(self, word: bytes) -> list[int]:
        """The one path whose labels spell the word: each place is reached by exactly one of the arcs that end there."""
        n, arcs, labels = len(word), self.arcs, self._labels
        if word in arcs:
            return [arcs[word]]
        last: list[int] = [-1] * (n + 1)
        for i in range(n):
            own = []
            for k in range(i + 1, min(n, i + self.longest) + 1):
                part = word[i:k]
                if part in arcs:
                    own.append(arcs[part])
                elif part not in labels.beginnings:
                    break
            if own and i:
                ts = np.array(own, np.int64)
                own = ts[self.allows(np.full(len(ts), last[i]), ts)].tolist()
            for t in own:
                last[i + len(self.labels[t])] = t
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(self.labels[last[at]])
        return path[::-1]

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each word has; words of up to SHORT bytes step through the table together."""
        sizes = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        data = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
        n = sizes[short]
        starts = np.cumsum(n) - n
        where, token = self._labels.all_in(data, np.repeat(starts + n, n))
        step = (where - np.repeat(starts, n)[where]).astype(np.int8)
        order = np.argsort(step, kind="stable")
        where, token = where[order], token[order]
        ends = np.searchsorted(step[order], np.arange(SHORT + 1))
        last = np.full(len(data) + 1, -1, np.int64)  # the token that ends before each place, of the word that the byte before is in
        for i in range(SHORT):
            at, t = where[ends[i] : ends[i + 1]], token[ends[i] : ends[i + 1]]
            if not len(at):
                break
            if i:
                ok = self.allows(last[at], t)
                at, t = at[ok], t[ok]
            last[at + self.lengths[t]] = t
        # back from the end of each word
        path, counts, at, live = [], np.zeros(len(short), np.int64), starts + n, np.flatnonzero(n)
        while len(live):
            t = last[at[live]]
            path.append((live, t))
            counts[live] += 1
            at[live] -= self.lengths[t]
            live = live[at[live] > starts[live]]
        every = np.zeros(len(words), np.int64)
        every[short] = counts
        if sum(int(self.lengths[t].sum()) for _, t in path) != len(data):
            raise ValueError("a word has no path")
        long = {int(i): self.encode(words[i]) for i in np.flatnonzero(sizes > SHORT)}
        for i, ids in long.items():
            every[i] = len(ids)
        stop = np.cumsum(every)
        out = np.zeros(int(stop[-1]) if len(words) else 0, "<u4")
        for k, (live, t) in enumerate(path, 1):
            out[stop[short[live]] - k] = t
        for i, ids in long.items():
            out[stop[i] - len(ids) : stop[i]] = ids
        return out, every


class _LabelTable:
    """The labels of arcs and their beginnings by 64-bit hash; ``all_in`` finds the arcs in many words at once.

    A beginning is known by the beginning without its last byte and that byte, so what is found is equal byte by byte.
    """

    def __init__(self, labels: list[bytes], arcs: list[int]) -> None:
        self.beginnings = {labels[t][:k] for t in arcs for k in range(1, len(labels[t]) + 1)}
        parts = sorted(self.beginnings)
        of = {labels[t]: t for t in arcs}
        length = np.array([len(x) for x in parts], np.int64)
        data, at, h = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, np.zeros(len(parts), np.uint64)
        for k in range(int(length.max())):
            more = np.flatnonzero(length > k)
            h[more] = self._step(h[more], data[at[more] + k])
        self.arc = np.array([of.get(x, -1) for x in parts], np.int64)
        place = {x: i for i, x in enumerate(parts)}
        self.parent, self.last = np.array([place.get(x[:-1], -1) for x in parts], np.int64), data[at + length - 1]
        self.bits = (4 * len(parts)).bit_length()
        slots = np.full(1 << self.bits, -1, np.int64)
        left, slot = np.arange(len(parts)), self._slot(h)
        while len(left):
            free = left[slots[slot[left]] < 0]
            slots[slot[free]] = free
            left = left[slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(slots) - 1)
        self.slots = slots

    @staticmethod
    def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h + byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def all_in(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, token) of every arc that begins at any byte of ``data`` and ends by that byte's ``stop``."""
        live, h, node = np.arange(len(data)), np.zeros(len(data), np.uint64), np.full(len(data), -1, np.int64)
        where, token = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k = 0
        while len(live):
            byte = data[live + k]
            h = self._step(h, byte)
            k += 1
            slot, known, open_ = self._slot(h), np.full(len(live), -1, np.int64), np.arange(len(live))
            while len(open_):
                i = self.slots[slot[open_]]
                hit = (i >= 0) & (self.parent[i] == node[open_]) & (self.last[i] == byte[open_])
                known[open_[hit]] = i[hit]
                open_ = open_[(i >= 0) & ~hit]
                slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            some = np.flatnonzero(known >= 0)  # what begins no label is not followed further
            arc = self.arc[known[some]]
            where.append(live[some[arc >= 0]]), token.append(arc[arc >= 0])
            some = some[live[some] + k < stop[live[some]]]
            live, h, node = live[some], h[some], known[some]
        return np.concatenate(where), np.concatenate(token)


def _removed(cut: dict[int, int], n: int, left: list[int], right: list[int], born: list[int], t: int, a: int) -> bool:
    """Whether a gadget so far has removed arc a from the state that t leads to; used while the gadgets are built."""
    r, until = t, 1 << 60  # t's state is a copy of its right part's as it stood when t was made, and so on
    while r >= 0:
        b, upto = a, 1 << 60  # arc a was there where its left part was when a was made, and so on
        while b >= 0:
            k = cut.get(r * n + b)
            if k is not None and k < until and k <= upto:
                return True
            upto, b = born[b], left[b]
        until, r = born[r], right[r]
    return False


class ByteBpe:
    """A byte-level BPE vocabulary file (its JSON text) compiled; ``special`` tokens in texts are found as such."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        labels = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            labels[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            labels[i] = token.encode()
        single = [vocab[c] for c in letters]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.labels = labels
        self.lengths = np.array([len(x) for x in labels], np.int64)
        self._joined, self._at = np.frombuffer(b"".join(labels), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.automaton = MergeAutomaton(labels, single, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.words = WordTable(lambda new: self.automaton.encode_many([w.encode() for w in new]))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode_all(self, texts: list[str], special: bool = True) -> Iterator[np.ndarray]:
        """Ids of whole texts, one after the other, as unsigned 32-bit numbers."""
        marked = {i for i, t in enumerate(texts) if special and any(s in t for s in self.special)}
        for i, ids in enumerate(encode_texts(["" if i in marked else t for i, t in enumerate(texts)], self.words, True, lambda part: part)):
            if i in marked:
                parts = self.split.split(texts[i])
                plain = iter(list(encode_texts(parts[::2], self.words, True, lambda part: part)))
                ids = np.concatenate([np.array([self.special[p]], "<u4") if k % 2 else next(plain) for k, p in enumerate(parts)])
            yield ids

    def encode(self, text: str, special: bool = True) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all([text], special)).tobytes()

    def decode(self, ids: np.ndarray | bytes) -> bytes:
        """The labels of the arcs, one after the other."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self._joined[np.repeat(self._at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


_COMPILED: dict[str, ByteBpe] = {}


def compiled(source: str) -> ByteBpe:
    """The compiled vocabulary; once per Python worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = ByteBpe(source)
    return _COMPILED[key]


def vocabulary(path: str) -> str:
    """The text of a vocabulary file, read on the driver; tasks get it as a broadcast of a few MB, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, then ``ids`` array<int> and/or ids_sha256 and decoded_sha256.

    Whole texts are encoded, a null one as the empty text (no tokens); special tokens written in a text are found as such.
    Decoding gives the text back.  Identifiers may be null or repeat; extra columns are ignored.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(source.value)
        for batch in batches:
            n, lists, own, back = [], [], [], []
            for got in bpe.encode_all(pc.fill_null(batch.column(1), "").to_pylist()):
                n.append(len(got))
                if ids:
                    lists.append(got.view("<i4"))
                if digests:
                    own.append(hashlib.sha256(got).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(got).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64())]
            names = ["doc_id", "n_tokens"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32()))), names.append("ids")
            if digests:
                columns += [pa.array(own, pa.string()), pa.array(back, pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each id list; null lists give null texts, broken UTF-8 the replacement character."""
    source = encoded.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = compiled(source.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def op1_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), ids=False, digests=True)
