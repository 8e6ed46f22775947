"""Token counts by section: offset-mapped attribution.

A document is encoded once and whole.  The lengths of the arc labels give every token's span of bytes, and so of characters;
the spans are joined with the sections as intervals, by binary search.  A token that lies over a boundary is allocated by
a rule:

* ``most``: the section with most of its characters, the earlier one among equals;
* ``first`` / ``last``: the section with the first / last of its characters that lie in any.

Characters that several sections share belong to the one that starts first, of those the one that ends first, then the
one with the smaller number; a section that has none of its own has count 0.  Tokens that touch no section are counted as
section -1, so the counts of a document add up to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, compiled, default_path, vocabulary
from .common import table

RULES = ("most", "first", "last")


def token_spans(bpe: ByteBpe, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token of a text; tokens that share a character both have it."""
    ends = np.cumsum(bpe.lengths[ids])
    starts = ends - bpe.lengths[ids]
    if text.isascii():
        return starts, ends
    counted = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return counted[starts] - 1, counted[ends - 1]


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section of each token, -1 for none; sections are disjoint and in order."""
    low = np.searchsorted(stops, first, "right")
    high = np.searchsorted(starts, end, "left") - 1
    out = np.where(high < low, -1, high if rule == "last" else low)
    if rule == "most":
        for i in np.flatnonzero(high > low):
            own = slice(low[i], high[i] + 1)
            out[i] = low[i] + np.argmax(np.minimum(stops[own], end[i]) - np.maximum(starts[own], first[i]))
    return out


def _disjoint(sections: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, stop) in order of start; what two sections share belongs to the one that starts first."""
    names, starts, stops, at = [], [], [], 0
    for name, start, stop in sorted(sections, key=lambda s: (s[1], s[2], s[0])):
        start = max(start, at)
        if stop > start:
            names.append(name), starts.append(start), stops.append(stop)
            at = stop
    return np.array(names, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)


def count_tokens(
    docs: DataFrame, tokenizer: str, split: str | None = r"\n+", sections: DataFrame | None = None, rule: str = "most", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens): one row per section, and one for section -1 of every document.

    Sections are the non-empty stretches between matches of ``split``, numbered from 0, or the rows of ``sections``
    (doc_id, section, start, stop in characters), of which those with a null or with no characters are ignored.  Every
    section has a row with its own span within the text, one without tokens, one inside another and a repeated one too; the
    row of section -1 has the whole text as its span.  Null texts are empty.  Rows that repeat an identifier are counted each; extra columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}: {rule}")
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own_sections = sections is not None
    if own_sections:
        clean = sections.select(F.col(id_col).alias("of_id"), *(F.col(c).cast("long") for c in ("section", "start", "stop"))).dropna()
        given = clean.groupBy("of_id").agg(F.collect_list(F.struct("section", "start", "stop")).alias("given"))
        rows = rows.join(given, rows["doc_id"] == given["of_id"], "left").drop("of_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, between = compiled(source.value), re.compile(split or r"\n+")
        for b in batches:
            row, name, first, last, count = [], [], [], [], []
            own = b.column("given").to_pylist() if own_sections else None
            texts = pc.fill_null(b.column("text"), "").to_pylist()
            for i, (text, ids) in enumerate(zip(texts, bpe.encode_all(texts), strict=True)):
                if own is None:
                    cuts = [0, *(x for m in between.finditer(text) for x in m.span()), len(text)]
                    parts = [(k, s, e) for k, (s, e) in enumerate((s, e) for s, e in zip(cuts[::2], cuts[1::2], strict=True) if e > s)]
                else:
                    parts = [(s["section"], max(s["start"], 0), min(s["stop"], len(text))) for s in own[i] or []]
                    parts = sorted((p for p in parts if p[2] > p[1]), key=lambda p: (p[1], p[2], p[0]))
                # tokens go to what each section has of its own; rows are those of all sections
                held, starts, stops = _disjoint([(k, s, e) for k, (_, s, e) in enumerate(parts)])
                a, e = token_spans(bpe, text, ids)
                counts = np.zeros(len(parts) + 1, np.int64)
                counts[np.append(0, held + 1)] = np.bincount(allocate(a, e, starts, stops, rule) + 1, minlength=len(held) + 1)
                given = np.array(parts, np.int64).reshape(-1, 3)
                row.append(np.full(len(parts) + 1, i))
                name += [np.array([-1]), given[:, 0]]
                first += [np.array([0]), given[:, 1]]
                last += [np.array([len(text)]), given[:, 2]]
                count.append(counts)
            cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(cat(row)), cat(name), cat(first), cat(last), cat(count)], ["doc_id", "section", "start", "stop", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, section long, start long, stop long, n_tokens long")


def op5_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
