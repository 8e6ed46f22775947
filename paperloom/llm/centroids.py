"""Centroid clustering with exact integer arithmetic; the nearest centroid is found by the threshold algorithm.

Each dimension has its list of centroids sorted by value.  From a vector's value the list is walked outward, the nearer side
first; a centroid that turns up in any list is compared in full.  No centroid that has not turned up is nearer than the sum
of the squared distances of the next entries, so the walk stops when that sum is above the best distance found.

Vectors are turned into integers once and written; a round reads them, keeps sums per cluster in each task, and sends the
driver one row per cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table

#: Components are below this bound in size, so squared distances of 64 of them fit a long with room for the ends of lists.
LIMIT, END = 1 << 25, 1 << 27
#: Vectors that are walked at once.
ROWS = 2048


def quantised(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have exactly ``dims`` finite components, and those rows' floor(scale * x)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    whole = np.isfinite(x).all(1) if len(x) else np.zeros(0, bool)
    x = np.floor(x[whole] * scale)
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component is beyond {LIMIT // scale}, so distances would not fit a long")
    return rows[whole], x.astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): ``v`` has the integers as little-endian 32-bit ones; other vectors go."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = quantised(b.column("x"), dims, scale)
            v = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(v, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("x")).mapInArrow(turn, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, v binary")


class SortedLists:
    """The centroids by value in each dimension, with an end mark on both sides."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.k, self.dims = centroids.shape
        order = np.argsort(self.centroids, axis=0, kind="stable")
        ends = np.full((1, self.dims), END, np.int64)
        self.values = np.concatenate((-ends, np.take_along_axis(self.centroids, order, 0), ends))
        self.numbers = np.concatenate((order[:1], order, order[-1:]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its centroid (of equal distance the smaller number), the squared distance, and how many were compared."""
        n, every = len(x), np.arange(self.dims)
        best, label, compared = np.full(n, np.iinfo(np.int64).max), np.full(n, self.k), np.zeros(n, np.int64)
        low = np.stack([np.searchsorted(self.values[1:-1, d], x[:, d], "right") for d in range(self.dims)], 1)  # 0 is the end mark
        high, seen, rows = low + 1, np.zeros((n, self.k), bool), np.arange(n)
        below, above = x - self.values[low, every], self.values[high, every] - x
        while len(rows):
            down = below <= above
            found = np.zeros((len(rows), self.k), bool)
            found[np.arange(len(rows))[:, None], np.where(down, self.numbers[low, every], self.numbers[high, every])] = True
            new = found & ~seen[rows]
            seen[rows] |= found
            for c in range(self.k):
                own = rows[new[:, c]]
                distance = ((x[own] - self.centroids[c]) ** 2).sum(1)
                nearer = (distance < best[own]) | ((distance == best[own]) & (c < label[own]))
                best[own[nearer]], label[own[nearer]] = distance[nearer], c
                compared[own] += 1
            low, high = low - down, high + ~down
            value = x[rows]
            below, above = value - self.values[np.maximum(low, 0), every], self.values[np.minimum(high, self.k + 1), every] - value
            frontier = (np.minimum(below, above) ** 2).sum(1)
            on = frontier <= best[rows]
            rows, low, high, below, above = rows[on], low[on], high[on], below[on], above[on]
        return label, best, compared


def _walked(batch: pa.RecordBatch, lists: SortedLists) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    column = batch.column("v")
    for at in range(0, len(column), ROWS):
        own = column.slice(at, ROWS)
        x = np.frombuffer(b"".join(own.to_pylist()), "<i4").reshape(len(own), -1).astype(np.int64)
        label, distance, _ = lists.nearest(x)
        yield at, x, label, distance


def sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """For each cluster with vectors: how many, their distances added up, and their components added up."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total = SortedLists(centroids), np.zeros((k, dims + 2), np.int64)
        for b in batches:
            for _, x, label, distance in _walked(b, lists):
                for c in range(k):
                    own = label == c
                    total[c] += [int(own.sum()), int(distance[own].sum()), *x[own].sum(0)]
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(total[c, at])], ["cluster", "at", "part"])

    added = kept.select("v").mapInArrow(add, "cluster int, at int, part long").groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, list[int]] = {}
    for c, at, total in added.collect():  # k rows of dims + 2 numbers
        out.setdefault(c, [0] * (dims + 2))[at] = int(total)
    return {c: (t[0], t[1], t[2:]) for c, t in out.items()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that is kept, and the final centroids.

    Kept are vectors of exactly ``dims`` components, none null or not finite, as integers floor(scale * x).  The ``k`` with the
    smallest sha256 of ``seed:vec_id`` are the first centroids (of equal hashes the smaller vector bytewise; a null identifier
    comes last).  A round assigns each vector to the nearest centroid (ties: smaller number) and moves each centroid that has
    vectors to the floor of their mean; rounds end early where none moves, as all further ones would be the same.

    Fewer kept vectors than ``k`` are that many centroids; none gives an empty table.  Rows that repeat an identifier are
    vectors of their own, extra columns count for nothing.  A component of 32,768 or more in size is an error.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    kept = durable(integer_vectors(vectors, id_col, vector_col, dims, scale))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in first], np.int64).reshape(-1, dims)
    out = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], out), []
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, _, total) in sums(kept, centroids).items():
            moved[c] = [s // n for s in total]
        if (moved == centroids).all():
            break
        centroids = moved
    inertia = {c: d for c, (_, d, _) in sums(kept, centroids).items()}
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    whole, of = sum(inertia.values()), np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for b in batches:
            for at, x, label, distance in _walked(b, lists):
                columns = [b.column("vec_id").slice(at, len(x)), pa.array(label, pa.int32()), pa.array(distance), pa.array(of[label]), pa.array(np.full(len(x), whole, np.int64)), pa.array([hashes[c] for c in label], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(assign, out), centroids.tolist()


def op12_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    start = "sha256('3:' || CAST(vec_id AS VARCHAR))"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {start}) - 1 AS c, v AS w FROM (SELECT * FROM kept ORDER BY {start} LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        pairs = f"SELECT r, vec_id, v, c, w, CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i}"
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            mean = f"SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) g(i) GROUP BY c, i"
            parts.append(f"m{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS u FROM ({mean}) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(u, w) AS w FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds}"


OP12_SQL = _sql()
