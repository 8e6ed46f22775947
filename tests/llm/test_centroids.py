import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import centroids as C


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    centers = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    return sorted(str((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest())) for i, d, j in found)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string")


def vectors(rng, n, dims=64):
    return [np.float32(rng.gauss(0, 0.2)).item() for _ in range(dims)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_like_brute_force(spark, kind):
    rng = random.Random(6)
    rows = [(k, vectors(rng, 1)) for k in range(150)]
    rows += [(k, rows[3][1]) for k in range(200, 260)] + [(5, rows[9][1]), (None, rows[8][1])]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.1] * 63), (305, [float("nan")] + [0.1] * 63), (306, [float("-inf")] + [0.1] * 63), (307, [-0.0001] * 64), (308, [0.0] * 64)]
    got = C.cluster(table(spark, rows, kind))[0].collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(k, [0.25] * 64) for k in range(5)]
    got, centers = C.cluster(table(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows) and len(centers) == 5
    assert {r.cluster for r in got.collect()} == {0}
    got, centers = C.cluster(table(spark, [(1, None), (2, [0.5])]))
    assert got.count() == 0 and centers == [] and C.cluster(table(spark, []))[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        C.cluster(table(spark, [(1, [1e9] * 64)]))


def test_threshold_algorithm_is_exact_and_stops_early():
    rng = np.random.default_rng(7)
    for k, dims in [(1, 3), (8, 64), (40, 2), (200, 3)]:
        centers = rng.integers(-300, 300, (k, dims))
        x = np.concatenate((rng.integers(-400, 400, (500, dims)), centers, np.zeros((1, dims), np.int64)))
        label, distance, compared = C.SortedLists(centers).nearest(x)
        every = ((x[:, None] - centers[None]) ** 2).sum(2)
        assert (label == every.argmin(1)).all() and (distance == every.min(1)).all()  # argmin takes the first of equal ones
        assert k < 40 or compared.mean() < k / 3


def test_ties_go_to_the_smaller_number():
    label, distance, _ = C.SortedLists(np.array([[4, 0], [0, 0], [4, 0], [2, 2]])).nearest(np.array([[2, 0], [4, 0], [0, 0]]))
    assert label.tolist() == [0, 0, 1] and distance.tolist() == [4, 0, 0]
