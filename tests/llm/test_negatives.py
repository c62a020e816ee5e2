import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import negatives

LAST = negatives.NO_ID


def brute(rows, scale=256):
    """Rows (key, label, anchor, vector) to the answer, one anchor at a time over all rows."""
    good = []
    for key, label, anchor, vector in rows:
        if label is not None and vector is not None and all(v is not None and np.isfinite(v) for v in vector):
            point = [int(np.clip(np.floor(np.float64(v) * scale), -negatives.WIDEST, negatives.WIDEST)) for v in vector]
            good.append((LAST if key is None else key, label, bool(anchor) and key is not None, point))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    show = lambda k: None if k == LAST else k
    out = []
    for i, (key, label, anchor, point) in enumerate(good):
        if not anchor:
            continue
        every = sorted((-dot(point, p), k, c == label) for j, (k, c, _, p) in enumerate(good) if j != i)
        for s, k, _ in [x for x in every if x[2]][:5]:
            fit = [x for x in every if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(key, show(k), r + 1, show(n), -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out, key=str)


def found(spark, rows, schema="vec_id long, label int, a boolean, embedding array<double>"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    points = negatives.integer_points(df, 256, F.col("label"), F.col("a"))
    return sorted(map(tuple, negatives.hard_negatives(points).collect()), key=str)


def lumps(count, size, seed, spread):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((12, size)) + 0.6
    x = (centres[pick.integers(0, 12, count)] + spread * pick.standard_normal((count, size))) / np.sqrt(size)
    labels = np.where(pick.random(count) < 0.35, 0, pick.integers(0, 6, count))
    return [(i, int(labels[i]), i % 9 == 0, [float(v) for v in x[i]]) for i in range(count)]


@pytest.mark.parametrize("seed,cells", [(1, None), (2, (700, 100)), (3, (2000, 160))])
def test_equals_brute_force(spark, monkeypatch, seed, cells):
    if cells:
        monkeypatch.setattr(negatives, "CANDIDATE_CELLS", cells[0])
        monkeypatch.setattr(negatives, "ANCHOR_CELLS", cells[1])
    rows = lumps(420, 6, seed, 0.4)
    rows += [(rows[5][0], 1, False, rows[5][3])] * 3 + [rows[9], (None, 2, True, rows[3][3]), (None, 0, False, rows[4][3])]
    expected = brute(rows)
    assert len(expected) > 200 and found(spark, rows) == expected


def test_edges(spark):
    rows = [(0, 1, True, [0.5, 0.5]), (1, 1, False, [0.5, 0.5]), (2, 2, False, [0.5, 0.45]), (3, None, False, [0.5, 0.5]), (4, 2, False, None), (5, 2, False, [0.5, None]),
            (6, 2, False, [float("nan"), 0.5]), (7, 2, False, [float("inf"), 0.5]), (8, 3, True, [0.0, 0.0]), (9, 3, False, [1.0, 1.0]), (10, 3, True, []),
            (11, 4, False, [0.5, 0.5, 9.0]), (12, 4, True, [1e300, -1e300]), (13, 4, False, [1e300, -1e299]), (14, 5, True, [-1.0, -1.0]), (15, 5, False, [1.0, 1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, rows[1:3]) == []
    assert found(spark, [(0, 1, True, [0.5])]) == []


def test_walks_end_early_on_clustered_vectors():
    pick = np.random.default_rng(4)
    centres = pick.standard_normal((30, 16))
    y = np.floor(256 * (centres[pick.integers(0, 30, 20_000)] + 0.05 * pick.standard_normal((20_000, 16)))).astype(np.int64)
    x = np.floor(256 * (centres[3] + 0.05 * pick.standard_normal((50, 16)))).astype(np.int64)
    best = negatives.Best(50, 5)

    def visit(going, at, values):
        for g, line in zip(going, values):
            best.add(g, line, at)

    pairs = negatives.SharedList(x, y).walk(x, y, lambda: best.last, visit)
    assert pairs < 0.25 * 50 * 20_000
    every = x @ y.T
    for i in range(50):
        assert best.found[i][0].tolist() == sorted(every[i].tolist(), reverse=True)[:5]
