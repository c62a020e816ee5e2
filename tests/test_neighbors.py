import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import neighbors


def lumps(count, size, groups, seed, spread=0.05):
    pick = np.random.default_rng(seed)
    return pick.standard_normal((groups, size))[pick.integers(0, groups, count)] + spread * pick.standard_normal((count, size))


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in p], int(i % 3)) for i, p in enumerate(x)] + list(extra), "key long, v array<double>, label int")


def brute(q, keys, x, ref_keys, k, itself=False, same=None):
    out = {}
    for i, (key, p) in enumerate(zip(keys, q)):
        far = np.sqrt(((x - p) ** 2).sum(1))
        order = [j for j in np.lexsort((ref_keys, far)) if not (itself and ref_keys[j] == key) and (same is None or same[i] == same[j])][:k]
        out[key] = [(int(ref_keys[j]), round(float(far[j]), 9)) for j in order]
    return out


def answer(joined):
    return {r.key: [(n.key, round(n.distance, 9)) for n in r.neighbors] for r in joined.collect()}


@pytest.mark.parametrize("shape,block,part", [((500, 6, 12), 40, 100), ((700, 20, 5), 64, 64), ((300, 3, 300), 16, 48)])
def test_many_blocks_equal_all_pairs(spark, monkeypatch, shape, block, part):
    monkeypatch.setattr(neighbors, "PART_ROWS", part)
    x = lumps(*shape, seed=shape[0])
    x[20:60] = x[3]  # a hot set of copies
    keys = np.arange(len(x))
    df = frame(spark, x)
    assert answer(neighbors.nearest(df, None, "key", "v", 4, block_rows=block)) == brute(x, keys, x, keys, 4, True)
    assert answer(neighbors.nearest(df, None, "key", "v", 3, within="label", block_rows=block)) == brute(x, keys, x, keys, 3, True, keys % 3)
    other = lumps(150, shape[1], 30, seed=9, spread=2)
    asked = frame(spark, other)
    assert answer(neighbors.nearest(asked, df, "key", "v", 5, block_rows=block)) == brute(other, np.arange(150), x, keys, 5)


def test_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PART_ROWS", 50)
    x = lumps(400, 4, 8, seed=1)
    label = np.where(np.arange(400) < 200, 0, np.arange(400))  # a hot group and many of one row
    df = spark.createDataFrame([(i, [float(v) for v in p], int(g)) for i, (p, g) in enumerate(zip(x, label))], "key long, v array<double>, label int")
    got = answer(neighbors.nearest(df, None, "key", "v", 3, within="label", block_rows=25))
    assert got == brute(x, np.arange(400), x, np.arange(400), 3, True, label)
    assert got[350] == []
    asked = frame(spark, lumps(20, 4, 2, seed=5))
    strange = asked.withColumn("label", F.lit(12345))
    assert all(n == [] for n in answer(neighbors.nearest(strange, df, "key", "v", 3, within="label", block_rows=25)).values())


def test_fewer_references_than_wanted(spark):
    df = frame(spark, lumps(3, 2, 1, seed=2))
    assert {len(n) for n in answer(neighbors.nearest(df, None, "key", "v", 5)).values()} == {2}
    nothing = df.where("key < 0")
    assert all(n == [] for n in answer(neighbors.nearest(df, nothing, "key", "v", 5)).values())
    assert answer(neighbors.nearest(nothing, df, "key", "v", 5)) == {}


def test_clustered_vectors_rule_out_most_pairs(spark):
    x = lumps(12_000, 64, 300, seed=3)
    df = frame(spark, x)
    assert neighbors.pairs_looked_at(df, None, "v", 5, block_rows=256) < 0.1
    assert neighbors.pairs_looked_at(frame(spark, np.random.default_rng(1).random((1500, 64))), None, "v", 5, block_rows=256) <= 1.0
