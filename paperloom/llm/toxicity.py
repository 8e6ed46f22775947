"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic rows are used as examples; all other training text is unlabelled.  A logistic model over hashed
cues (words and their first 4, 5 and 6 bytes) minimises the class-prior-corrected risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

in numpy.  Cues are screened first, by counts over the training rows that Spark sums; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .hashing import release_memory, word_cues

#: Hashed cues; the model is one weight for each, so its size does not depend on the data.
CUES = 1 << 20
PREFIXES = (4, 5, 6)
#: Bounds of the training sample, in rows: confirmed toxic ones and unlabelled ones, by hash of their identifier.
POSITIVES, UNLABELLED = 6_000, 18_000
#: Cues that pass the screening, at most, those with the clearest difference first.
SCREENED = 20_000
CLEAR = 6.0
THRESHOLD = 0.3
#: Rows that are filtered and sent back at once.
SLICE = 1000


@dataclass(frozen=True)
class Model:
    cues: np.ndarray  # sorted cue numbers
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(CUES, np.float32)
        full[self.cues] = self.weights
        return full


def document_cues(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Sorted distinct cue numbers of each text; of those that ``wanted`` marks only, if it is given."""
    for _, counts, cues in word_cues(column, PREFIXES):
        cues = (cues & np.uint64(CUES - 1)).astype(np.int64)  # words x kinds
        ends = np.cumsum(counts)
        if wanted is None:
            for lo, hi in zip(ends - counts, ends, strict=True):
                yield np.unique(cues[lo:hi])
        else:
            hit = wanted[cues]
            rows, _ = np.nonzero(hit)
            owner, found = np.searchsorted(ends, rows, "right"), cues[hit]
            at = np.searchsorted(owner, np.arange(len(counts) + 1))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                yield np.unique(found[lo:hi])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, positive, unlabelled) of the bounded training sample; its identifiers are broadcast, 24,000 at most."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id", F.lit(7))
    pos = rows.filter("y = 1").orderBy(order, "id").limit(POSITIVES).select("id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    unl = rows.orderBy(order, "id").limit(UNLABELLED).select("id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    ids = pos.unionByName(unl).groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return text.join(F.broadcast(ids), "id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> Model | None:
    """A model from the confirmed toxic rows of ``labels`` and unlabelled text, or None where no row is toxic.

    ``prior`` is the share of toxic texts; by default the share among ``labels``.  Labels other than 1 count for nothing
    else.  Rows without an identifier are left out; of repeated labels the highest counts.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col)
    if prior is None:
        prior = labels.filter(F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    if not prior:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CUES), np.int32)
        for b in batches:
            p, u = b.column("p").to_numpy(zero_copy_only=False), b.column("u").to_numpy(zero_copy_only=False)
            for i, own in enumerate(document_cues(b.column("text"))):
                seen[0, own] += p[i]
                seen[1, own] += u[i]
        some = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["cue", "p", "u"])
        release_memory()

    sizes = sample.agg(F.sum("p"), F.sum("u")).first()
    n_p, n_u = int(sizes[0] or 0), int(sizes[1] or 0)
    if not n_p or not n_u:
        return None
    counted = sample.mapInArrow(count, "cue long, p int, u int").groupBy("cue").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # log-likelihood gain of a cue's count among toxic rows over its count if it were independent of toxicity
    p, expected = F.col("p"), (F.col("u") + 0.5) * (n_p / n_u)
    gain = p * F.log(p / expected) - (p - expected)
    top = counted.filter((p >= 3) & (p > expected)).withColumn("gain", gain).filter(F.col("gain") > CLEAR).orderBy(F.desc("gain"), "cue").limit(SCREENED)
    cues = np.array(sorted(r[0] for r in top.select("cue").collect()), np.int64)
    wanted = np.zeros(CUES, bool)
    wanted[cues] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array(list(document_cues(b.column("text"), shared.value)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), own], ["p", "u", "cues"])
        release_memory()

    rows = sample.mapInArrow(keep, "p int, u int, cues array<long>").toArrow()  # the bounded sample, screened cues only
    p, u = (rows.column(k).to_numpy().astype(float) for k in ("p", "u"))
    lists = rows.column("cues").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return _fit(p, u, np.repeat(np.arange(len(p)), sizes), np.searchsorted(cues, lists.flatten().to_numpy()), cues, float(prior))


def _fit(p: np.ndarray, u: np.ndarray, owner: np.ndarray, cols: np.ndarray, cues: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss; row ``owner`` has cue ``cues[cols]``."""
    wp, wu = p / p.sum(), u / u.sum()
    w, bias = np.zeros(len(cues)), np.log(prior / (1 - prior)) if prior < 1 else 1.0
    m = v = np.zeros(len(cues) + 1)
    for t in range(1, steps + 1):
        f = np.bincount(owner, w[cols], len(p)) + bias
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        neg = np.logaddexp(0, f)
        below = wu @ neg - prior * (wp @ neg)
        g_pos, g_neg = prior * wp * (s - 1), (wu - prior * wp) * s
        # where the corrected risk falls below zero the step goes back up instead
        g = g_pos + g_neg if below >= 0 else -g_neg
        grad = np.append(np.bincount(cols, g[owner], len(cues)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(cues, w.astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row: null texts are scored as empty ones, no model gives score 0."""
    weights, bias = (np.zeros(CUES, np.float32), -40.0) if model is None else (model.table(), model.bias)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        wanted = weights != 0
        for b in batches:
            f = np.array([weights[own].sum() for own in document_cues(b.column("text"), wanted)], float) + bias
            s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
            s = s if model is not None else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below the threshold.

    Only texts go to Python and only a flag comes back; rows wait for it where they are.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), model.bias))

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        wanted = weights != 0
        for whole in texts:
            parts = []
            for first in range(0, len(whole), SLICE):
                f = np.array([weights[own].sum() for own in document_cues(whole.slice(first, SLICE), wanted)], float) + bias
                parts.append(1 / (1 + np.exp(-np.clip(f, -40, 40))) < threshold)
            yield pa.array(np.concatenate([np.zeros(0, bool), *parts]), pa.bool_())
        release_memory()

    return docs.filter(F.arrow_udf(clean, "boolean")(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """crc32 of the identifier as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
