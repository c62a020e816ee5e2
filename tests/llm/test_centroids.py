import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import centroids


def lloyd(points, start, rounds):
    middle = np.array(start)
    for r in range(rounds + 1):
        far = ((points[:, None, :] - middle[None, :, :]) ** 2).sum(2)
        nearest = far.argmin(1)
        if r < rounds:
            middle = np.array([points[nearest == c].sum(0) // (nearest == c).sum() if (nearest == c).any() else middle[c] for c in range(len(middle))])
    return nearest, far.min(1), middle


def lumps(count, size, seed):
    pick = np.random.default_rng(seed)
    return np.floor(64 * (pick.standard_normal((9, size))[pick.integers(0, 9, count)] + 0.2 * pick.standard_normal((count, size)))).astype(np.int64)


@pytest.mark.parametrize("size,k,seed", [(2, 3, 1), (3, 12, 2), (8, 16, 3), (16, 40, 4)])
def test_bounds_never_change_an_assignment(size, k, seed):
    x = lumps(600, size, seed)
    x[300:340] = x[3]
    middle = x[:: 600 // k][:k].copy()
    middle[-1] = middle[0]
    n, moved, whole = len(x), None, 0
    first, second, upper, lower = np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.zeros(n)
    for _ in range(8):
        if moved is not None:
            far = np.argsort(moved)[::-1]
            lower -= np.where(first == far[0], moved[far[1]], moved[far[0]])
        search = centroids.Shallot(middle)
        distance = search.assign(x, first, second, upper, lower)
        every = ((x[:, None, :] - middle[None, :, :]) ** 2).sum(2)
        assert (first == every.argmin(1)).all() and (distance == every.min(1)).all()
        others = every.copy()
        others[np.arange(n), first] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(others.min(1)) + 1e-9).all()
        whole += search.compared
        means = np.array([x[first == c].sum(0) // (first == c).sum() if (first == c).any() else middle[c] for c in range(k)])
        moved = np.sqrt(centroids.squared(means, middle)) * (1 + centroids.SLACK)
        middle = means
    if k >= 16:
        assert whole < 0.5 * 8 * n * k


def test_rounds_equal_plain_ones_for_any_layout(spark):
    x = lumps(900, 4, 7)
    x[500:700] = x[1]
    rows = [(i, [float(v) / 64 for v in p]) for i, p in enumerate(x)]
    rows += [(2000, None), (2001, [1.0, 2.0, 3.0]), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[4][1])]
    points = np.vstack([x, x[4]])
    order = sorted(range(900), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:10]
    nearest, far, middle = lloyd(points, points[order], 3)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got, final = centroids.clustered(df, 10, 3, 4, 64, "sha2(concat('1:', vec_id), 256)", ["vec_id"])
        assert (final == middle).all()
        got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect())
        assert got == sorted(zip([*range(900), -1], nearest.tolist(), far.tolist()))


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    none, middle = centroids.clustered(spark.createDataFrame([], schema), 16, 3, 2, 64, "vec_id", ["vec_id"])
    assert none.collect() == [] and len(middle) == 0
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [3e38, -3e38])]
    got, middle = centroids.clustered(spark.createDataFrame(rows, schema), 16, 3, 2, 64, "vec_id", ["vec_id"])
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == [(1, 0, 0), (1, 0, 0), (2, 2, 0)]
    assert middle.tolist() == [[32, 32], [32, 32], [centroids.WIDEST, -centroids.WIDEST]]
    one, _ = centroids.clustered(spark.createDataFrame(rows[:1], schema), 16, 2, 2, 64, "vec_id", ["vec_id"])
    assert [(r.cluster, r.distance) for r in one.collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        centroids.clustered(spark.createDataFrame(rows, schema).withColumn("cluster", F.lit(1)), 2, 1, 2, 64, "vec_id", ["vec_id", "cluster"])
