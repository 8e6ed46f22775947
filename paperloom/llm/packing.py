"""Best-fit packing: the configuration linear program, solved by multiplicative weights, then rounded.

A configuration is a multiset of lengths that fits into one sequence.  Only the histogram of lengths, one count for each
length up to the capacity, reaches the driver.  There ``program`` covers all counts by as little of configurations as it can:
each step prices the lengths by how little of them is covered so far, finds the most valuable completions of the least
covered ones by a knapsack table, and adds a part of these, until all are covered; the same prices bound the optimum from
below, and where uses and bound are not near, smaller parts are added.  Whole uses are kept, of the broken ones the larger are rounded up in place of the smaller, and what is left
goes through the program again, until it is a fiftieth of the pieces; this rounding loss is placed by best fit.
Spark then deals the pieces to the slots of the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import default_path, vocabulary
from .common import durable, table
from .hashing import release_memory
from .words import SPACE, WordTable, classes, encode_texts

CAPACITY = 2048
#: A program's uses and their lower bound are near at this gap; SHARES are the parts of a length that one configuration may
#: cover, tried one after the other until they are; a price table serves BATCH configurations.
GAP, SHARES, BATCH, SHARPNESS = 0.01, (1.0, 0.2, 0.05), 24, 3.0
#: What is less than this is covered.
LEAST = 1e-7
#: What rounding may leave to best fit: this share of the pieces, and no more than one piece for each length.
LOSS = 0.02
#: A sequence less full than this has gaps; so many of those with the largest gaps are tried at most.
FULL, LOOSE = 0.97, 64
#: Pieces are ranked in parts: one for so many rows.
RANK_ROWS = 2_000

Config = tuple[tuple[int, int], ...]


def _price_table(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the capacity: best value of each room, and the length taken first (0: leave one token free)."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths, prices = lengths[prices > 0], prices[prices > 0]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        k = upto[room]
        most, taken = value[room - 1], 0
        if k:
            total = value[room - lengths[:k]]
            total += prices[:k]
            best = total.argmax()
            if total[best] > most:
                most, taken = total[best], lengths[best]
        value[room], choice[room] = most, taken
    return value, choice


def _complete(first: int, lengths: np.ndarray, prices: np.ndarray, value: np.ndarray, choice: np.ndarray, have: np.ndarray, capacity: int) -> Config:
    """The most valuable configuration with ``first``; a length that would be used more often than it occurs gives way to the next best."""
    parts, room, spare = Counter([first]), capacity - first, None
    while room > 0:
        n = int(choice[room])
        if not n:
            room -= 1
            continue
        if parts[n] >= have[n]:
            if spare is None:
                spare = have[lengths].copy()
                spare[np.searchsorted(lengths, list(parts))] -= list(parts.values())
            k = int(np.searchsorted(lengths, room, "right"))
            worth = np.where(spare[:k] > 0, value[room - lengths[:k]] + prices[:k], 0)
            best = int(worth.argmax()) if k else 0
            if not k or prices[best] <= 0 or spare[best] <= 0:
                break
            n = int(lengths[best])
        if spare is not None:
            spare[np.searchsorted(lengths, n)] -= 1
        parts[n] += 1
        room -= n
    return tuple(sorted(parts.items(), reverse=True))


@dataclass
class Program:
    """A covering solution: configurations and how often to use each, all uses, and a lower bound of what any solution needs."""

    used: dict[Config, float]
    total: float
    bound: float
    steps: int

    @property
    def gap(self) -> float:
        return self.total / self.bound - 1 if self.bound else 0.0


def _cover(counts: np.ndarray, capacity: int, share: float) -> Program:
    """Covers all counts; a configuration covers at most ``share`` of each of its lengths at once.

    Weights start equal, fall exponentially with what is covered beyond the whole's progress, and are the dual solution of the
    bound.  A configuration of a length that has run out since the prices were made waits for the next prices.
    """
    lengths = np.flatnonzero(counts)
    have = counts[lengths].astype(float)
    left, place = have.copy(), np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    volume = float((have * lengths).sum())
    out = Program({}, 0.0, volume / capacity, 0)

    def use(parts: Config, most: float) -> bool:
        at, times = place[[n for n, _ in parts]], np.array([k for _, k in parts], float)
        uses = min(float((left[at] / times).min()), most * float((have[at] / times).min()))
        if uses <= LEAST:
            return False
        out.used[parts] = out.used.get(parts, 0) + uses
        out.total += uses
        rest = left[at] - times * uses
        left[at] = np.where(rest < LEAST, 0, rest)
        return True

    while left.any():
        out.steps += 1
        cover = 1 - left / have
        progress = float((cover * have * lengths).sum() / volume)
        # long pieces first among equals, so that short ones remain to fill gaps
        prices = np.where(left > 0, lengths * (1 + 0.02 * lengths / capacity) * np.exp(-SHARPNESS * (cover - progress)), 0)
        value, choice = _price_table(lengths, prices, capacity)
        out.bound = max(out.bound, float((have * prices).sum() / value[capacity]))
        anchors = np.argsort(np.where(left > 0, cover - lengths / (4 * capacity), 9), kind="stable")[: min(BATCH, int((left > 0).sum()))]
        done = [use(_complete(int(lengths[i]), lengths, prices, value, choice, counts, capacity), share) for i in anchors if left[i] > 0]
        if not any(done):  # only traces are left, too little for the parts of a configuration
            n = int(lengths[anchors[0]])
            use(((n, min(capacity // n, int(counts[n]))),), 1.0) or left.__setitem__(anchors[0], 0)
    return out


def program(counts: np.ndarray, capacity: int) -> Program:
    """The configuration program of a histogram: the first covering solution within GAP of its bound, or the best."""
    best = None
    for share in SHARES:
        found = _cover(counts, capacity, share)
        if best is None or found.total < best.total:
            best = Program(found.used, found.total, max(found.bound, best.bound if best else 0.0), found.steps + (best.steps if best else 0))
        else:
            best.bound, best.steps = max(best.bound, found.bound), best.steps + found.steps
        if best.gap <= GAP:
            break
    return best


def _round(used: dict[Config, float], counts: np.ndarray, out: Counter, capacity: int) -> None:
    """Moves whole uses from ``counts`` to ``out``: all that are whole, then the broken ones rounded up, half as many as all of them make.

    Of the broken ones those without gaps come first, then the larger ones; the rest goes through the program again.
    """
    order = sorted(used.items(), key=lambda x: (-x[1], x[0]))
    gaps = {c: sum(n * k for n, k in c) < FULL * capacity for c in used}
    broken = sorted(((c, x % 1) for c, x in order), key=lambda x: (gaps[x[0]], -x[1], x[0]))
    ups = max(1, int(sum(x for _, x in broken) / 2))

    def take(config: Config, times: int) -> int:
        whole = min(times, *(int(counts[n]) // k for n, k in config))
        if whole > 0:
            out[config] += whole
            for n, k in config:
                counts[n] -= k * whole
        return whole

    for config, times in order:
        take(config, int(times))
    for config, _ in broken:
        ups -= take(config, 1)
        if not ups:
            break


def _best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Best fit by decreasing length; equal bins come out as one configuration."""
    bins: dict[int, list[dict[int, int]]] = {}
    free: list[int] = []
    for n in range(capacity, 0, -1):
        for _ in range(int(counts[n])):
            at = bisect_left(free, n)
            if at < len(free):
                room = free[at]
                own = bins[room].pop()
                if not bins[room]:
                    free.pop(at)
            else:
                room, own = capacity, {}
            own[n] = own.get(n, 0) + 1
            room -= n
            if room not in bins or not bins[room]:
                bins[room] = []
                insort(free, room)
            bins[room].append(own)
    return Counter(tuple(sorted(b.items(), reverse=True)) for same in bins.values() for b in same)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, Counter]:
    """Configurations and their whole numbers of uses: those of the program, and those of best fit for what rounding left."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    out: Counter = Counter()
    if counts[capacity]:
        out[((capacity, 1),)] = int(counts[capacity])  # a full piece is a configuration of its own
        counts[capacity] = 0
    loss = min(int(LOSS * counts.sum()), int((counts > 0).sum()))
    while counts.sum() > loss:
        _round(program(counts, capacity).used, counts, out, capacity)
    rest = _best_fit(counts, capacity)
    # uses that rounding up left with gaps are placed anew with the rest where that takes fewer sequences: one of each at most,
    # and as few of them as the saving takes
    gaps = sorted((sum(n * k for n, k in c), c) for c in out)
    best, loose, own = (out, rest), Counter(), counts.copy()
    for size, config in gaps[:LOOSE]:
        if size >= FULL * capacity:
            break
        loose[config] += 1
        for n, k in config:
            own[n] += k
        other = _best_fit(own, capacity)
        if out.total() - loose.total() + other.total() < best[0].total() + best[1].total():
            best = out - loose, other
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Configurations and their whole numbers of uses, which together hold exactly the pieces of the histogram."""
    main, rest = solve(histogram, capacity)
    return sorted((main + rest).items())


def slots(configs: list[tuple[Config, int]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays sorted by (length, rank): key, first rank, uses, first sequence, offset of the first copy."""
    rows, sequence, taken = [], 0, Counter()
    for config, times in configs:
        offset = 0
        for n, k in config:
            rows.append((n, taken[n], times, sequence, offset))
            taken[n] += k * times
            offset += n * k
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return (a[:, 0] << 48) | a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4]


def _normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


class WordIds:
    """Ids of whole texts as a tokenizer file with word ends gives them, by a table of words.

    Text is put in normal form C and lower case, words are split as the file's pattern does, and those not seen before are
    encoded by the library, many at once: each word's last id is one with a word end.  Texts that write special tokens are
    encoded as they are, and so are those with characters that the file's normaliser treats otherwise or whose normal
    form is not stable.
    """

    def __init__(self, source: str) -> None:
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(source)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        split = [tokenizers.pre_tokenizers.WhitespaceSplit(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.plain = tokenizers.Tokenizer(self.tokenizer.model)  # the merges alone, for words in normal form
        self.plain.pre_tokenizer = tokenizers.pre_tokenizers.Sequence(split)
        self.marks = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = json.loads(source)["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.astral = re.compile("[\U00010000-\U0010ffff]")
        own = self.tokenizer.normalizer.normalize_str
        white = {chr(c) for c in np.flatnonzero(classes() == SPACE)}
        odd = [chr(c) for c in [*range(128, 0xD800), *range(0xE000, 0x10000)] if chr(c) not in white and (own(chr(c)) != _normal(chr(c)) or max(_normal(chr(c))) > "\uffff")]
        self.odd = re.compile("[" + re.escape("".join({*odd, "Σ"})) + "]")
        self.words = WordTable(self._learn)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(new) else None

    def _plain(self, text: str) -> str | None:
        """The normal form of a text, or None where only the library knows it."""
        if any(m in text for m in self.marks):
            return None
        if text.isascii():
            return text.lower()
        if self.odd.search(text):
            return None
        normal = self.tokenizer.normalizer.normalize_str(text) if self.astral.search(text) else _normal(text)
        return normal if unicodedata.is_normalized("NFC", normal) else None

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [self._plain(t) for t in texts]
        for text, known, ids in zip(texts, plain, encode_texts([p or "" for p in plain], self.words, False, self._whole), strict=True):
            yield ids if known is not None else self._whole(text)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text])).tobytes()


_LOADED: dict[str, WordIds] = {}


def word_ids(source: str) -> WordIds:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordIds(source)
    return _LOADED[key]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut only where longer than capacity."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(source.value)
        end = np.array([end_id], "<u4")
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, got in enumerate(coder.encode_all(pc.fill_null(b.column("text"), "").to_pylist())):
                own = np.concatenate((got, end))
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.view("<i4"))
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32()))), names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: a packing of few sequences.

    Pieces of one length are ranked in parts of bounded size (a hash of their row), as many as its count asks for, whose
    counts are summed up per length; so a length that holds most rows is not one task.  Rows that repeat get places of their own.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    arrays = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))
    parts = pieces.sparkSession.createDataFrame([(n, -(-k // RANK_ROWS)) for n, k in histogram.items()], "length long, parts long")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    before = dealt.groupBy("length", "part").count()
    before = before.select("length", "part", (F.sum("count").over(W.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    order = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(order) - 1).join(before, ["length", "part"])
    ranked = ranked.select(*names, (F.col("before") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, times, sequence, offset = arrays.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (n << 48) | rank, "right") - 1
            k = rank - first[at]
            ids, offsets = sequence[at] + k % times[at], offset[at] + k // times[at] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ids), pa.array(offsets)], [*names, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole texts count, a null one is empty (its only id is ``end_id``).  Documents of up to ``capacity`` ids stay whole; only
    longer ones are cut, into full pieces and a last one.  Pieces of a sequence fill it from 0 without gaps and never
    beyond ``capacity``.  Identifiers may be null or repeat: each row is packed.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    return place(durable(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity)


def assemble(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>, doc_starts array<long>): the sequences themselves; a group holds one sequence."""
    whole = token_pieces(docs, tokenizer, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece"])
    rows = placed.join(whole, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("doc_starts"))


def op6_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
