import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.models import boosting
from tidewatch.models.boosting import BoostingModel, CategoryBoosting, CategoryBoostingModel, HistogramBoosting
from tidewatch.session import scratch_path

UNIT = boosting.UNIT


def plain(x, y, classes, edges, rounds, depth, rate, l2, symmetric):
    """The scores of each row after boosting, one node after the other on one machine."""
    counts = np.array([(y == c).sum() + 1.0 for c in range(classes)])
    start = np.log(counts[1:] / counts[:1]) if classes == 2 else np.log(counts / counts.sum())
    scores = np.tile(start, (len(x), 1))
    bins = np.array([[sum(v > e for e in edges[f]) for f, v in enumerate(row)] for row in x])
    for _ in range(rounds):
        if classes == 2:
            p = 1 / (1 + np.exp(-scores))
            g = p - (y == 1)[:, None]
        else:
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p - np.eye(classes)[y]
        g, h = np.rint(g * UNIT) / UNIT, np.rint(p * (1 - p) * UNIT) / UNIT
        step = np.zeros_like(scores)
        for cols in [list(range(scores.shape[1]))] if symmetric else [[c] for c in range(scores.shape[1])]:
            nodes, leaves = [np.arange(len(x))], []
            for _ in range(depth):
                gains = []
                for rows in nodes:
                    gain = np.zeros((x.shape[1], boosting.BINS - 1))
                    for f in range(x.shape[1]):
                        for b in range(boosting.BINS - 1):
                            left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                            if min(h[np.ix_(left, cols)].sum(), h[np.ix_(right, cols)].sum()) < 1.0:
                                gain[f, b] = 0 if symmetric else -np.inf
                                continue
                            value = lambda r: sum(g[r, c].sum() ** 2 / (h[r, c].sum() + l2) for c in cols)
                            gain[f, b] = value(left) + value(right) - value(rows)
                    gains.append(np.round(gain, 9))
                if symmetric:
                    gains = [np.round(sum(gains), 9)] * len(nodes)
                following = []
                for rows, gain in zip(nodes, gains):
                    if len(rows) == 0 or not gain.max() > 1e-9:
                        leaves.append(rows)
                        continue
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    following += [rows[bins[rows, f] <= b], rows[bins[rows, f] > b]]
                nodes = [r for r in following if len(r)]
            for rows in leaves + nodes:
                for c in cols:
                    step[rows, c] = -rate * g[rows, c].sum() / (h[rows, c].sum() + l2)
        scores = scores + step
    return scores


def sample(count, seed, classes):
    pick = np.random.default_rng(seed)
    x = np.round(pick.standard_normal((count, 3)), 1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)) % classes
    return x, y


def frame(spark, x, y):
    rows = [(i, [float(v) for v in p], float(c)) for i, (p, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, x array<double>, label double").withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("classes,symmetric", [(2, False), (3, False), (3, True), (2, True)])
def test_equals_a_plain_version(spark, monkeypatch, classes, symmetric):
    monkeypatch.setattr(boosting, "BINS", 8)
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    monkeypatch.setattr(boosting, "CELLS", 400)
    x, y = sample(500, 3, classes)
    settings = dict(rounds=3, depth=3, rate=0.3, bins=8, l2=1.5, symmetric=symmetric)
    model = HistogramBoosting(classes, **settings).fit(frame(spark, x, y).repartition(3))
    expected = plain(x, y, classes, model.edges, 3, 3, 0.3, 1.5, symmetric)
    assert np.allclose(model.scores(x), expected, atol=1e-9)
    assert len(model.history) == 4 and model.history[-1][1] < model.history[0][1]


def test_layout_and_way_of_adding_change_nothing(spark, monkeypatch):
    x, y = sample(400, 5, 3)
    df = frame(spark, x, y)
    settings = dict(rounds=4, depth=4, rows=0.7, columns=0.6)
    one = HistogramBoosting(3, **settings).fit(df.coalesce(1))
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    monkeypatch.setattr(boosting, "CELLS", 200)
    many = HistogramBoosting(3, **settings).fit(df.repartition(7))
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(one.rounds, many.rounds))


@pytest.mark.parametrize("classes,symmetric", [(2, False), (4, False), (4, True), (2, True)])
def test_one_task_gives_the_trees_of_a_job_a_level(spark, monkeypatch, classes, symmetric):
    x, y = sample(700, 11, classes)
    x[:20, 1] = np.nan
    df = frame(spark, x, y).withColumn("held", F.col("key") % 5 == 0)
    settings = dict(rounds=8, depth=6, rate=0.4, bins=16, rows=0.8, columns=0.7, symmetric=symmetric, validation="held", patience=4)
    context = spark.sparkContext
    context.setJobGroup(f"alone {classes} {symmetric}", "alone")
    try:
        alone = HistogramBoosting(classes, **settings).fit(df)
        assert len(context.statusTracker().getJobIdsForGroup(f"alone {classes} {symmetric}")) < 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 0)
    levels = HistogramBoosting(classes, **settings).fit(df.repartition(5))
    assert len(alone.rounds) == len(levels.rounds) > 0 and alone.history == levels.history
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all() for a, b in zip(alone.rounds, levels.rounds))


def test_held_out_rows_choose_the_rounds_and_teach_nothing(spark):
    x, y = sample(600, 8, 2)
    noise = np.random.default_rng(1).integers(0, 2, 600)
    held = np.arange(600) % 3 == 0
    df = frame(spark, x, np.where(held, y, np.where(np.arange(600) % 4 == 1, noise, y))).withColumn("held", F.col("key") % 3 == 0)
    model = HistogramBoosting(2, rounds=40, depth=5, rate=0.5, validation="held", patience=6).fit(df)
    losses = [h[3] for h in model.history]
    assert model.trees_used() == int(np.argmin(losses)) and len(losses) < 40
    swapped = df.withColumn("label", F.when(F.col("held"), 1 - F.col("label")).otherwise(F.col("label")))
    other = HistogramBoosting(2, rounds=3, depth=5, rate=0.5, validation="held").fit(swapped)
    assert all((a.value == b.value).all() for a, b in zip(model.rounds, other.rounds))
    assert all(h[0] == i for i, h in enumerate(model.history))


def test_missing_values_and_unlabelled_rows(spark):
    x, y = sample(200, 9, 2)
    x[:30, 0] = np.nan
    df = frame(spark, x, y).unionByName(frame(spark, x[:5], y[:5]).withColumn("label", F.lit(None).cast("double")))
    model = HistogramBoosting(2, rounds=5, depth=3).fit(df)
    scored = model.transform(df).collect()
    assert len(scored) == 205 and all(abs(sum(r.probability) - 1) < 1e-9 for r in scored)
    with pytest.raises(ValueError):
        HistogramBoosting(2).fit(df.where("label IS NULL"))


@pytest.fixture(scope="module")
def visits(spark):
    pick = np.random.default_rng(4)
    place = pick.integers(0, 40, 900)
    kind = (place * 7 % 3 + (pick.random(900) < 0.1)) % 3
    rows = [(i, float(pick.random()), None if p == 39 else f"p{p}", f"k{i % 2}", float(c), i % 5 == 0) for i, (p, c) in enumerate(zip(place.tolist(), kind.tolist()))]
    return spark.createDataFrame(rows, "key long, a double, place string, other string, label double, held boolean")


def test_category_shares_see_only_earlier_rows(spark, visits, monkeypatch):
    seen = {}
    real = CategoryBoostingModel.features

    def spy(self, df, known=False):
        out = real(self, df, known)
        if known:
            seen["rows"] = out.select("__order", "__y", "place", "x").collect()
        return out

    monkeypatch.setattr(CategoryBoostingModel, "features", spy)
    model = CategoryBoosting(3, ["a"], ["place", "other"], rounds=2, depth=3, validation="held").fit(visits)
    rows = sorted(seen["rows"], key=lambda r: r["__order"])
    assert len(rows) == visits.where("NOT held").count()
    counts = {}
    for r in rows:
        before = counts.setdefault(r.place, [0, 0, 0])
        for c in range(3):
            assert abs(r.x[1 + c] - (before[c] + model.priors[c]) / (sum(before) + 1)) < 1e-12
        before[r["__y"]] += 1


def test_categories_are_learnt_and_survive_saving(spark, visits):
    train, test = visits.where("key % 10 <> 3"), visits.where("key % 10 = 3")
    model = CategoryBoosting(3, ["a"], ["place", "other"], rounds=25, depth=4, rate=0.3, validation="held", patience=10).fit(train)
    scored = model.transform(test)
    right = scored.where("label = prediction").count() / test.count()
    assert right > 0.75
    path = scratch_path(spark, "boosting")
    model.save(spark, path)
    again = CategoryBoostingModel.load(spark, path).transform(test)
    assert sorted(again.select("key", "prediction").collect()) == sorted(scored.select("key", "prediction").collect())
    strange = test.withColumn("place", F.lit("never seen"))
    assert model.transform(strange).where("prediction IS NULL").count() == 0
    assert isinstance(BoostingModel.load(spark, path), BoostingModel)


def test_all_categories_share_one_table_of_ranges(visits, monkeypatch):
    from tidewatch.operators import prefix

    calls, real = [], prefix.in_ranges

    def counted(df, *order):
        calls.append(order)
        return real(df, *order)

    for module in (prefix, boosting):
        monkeypatch.setattr(module, "in_ranges", counted, raising=False)
    CategoryBoosting(3, ["a"], ["place", "other"], rounds=1, depth=2).fit(visits)
    assert calls == [("__order",)]
