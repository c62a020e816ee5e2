import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.models import dense
from tidewatch.models.dense import DenseModel, DenseNetwork
from tidewatch.session import scratch_path


def frame(spark, count=400, seed=1):
    pick = np.random.default_rng(seed)
    x = pick.standard_normal((count, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 0.7)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))], "key long, x array<double>, label double")
    return df.withColumn("features", array_to_vector("x"))


def test_gradients_are_those_of_the_loss():
    pick = np.random.default_rng(3)
    layers, x, y = [3, 5, 4, 3], pick.standard_normal((7, 3)), pick.integers(0, 3, 7)
    flat = dense._flat(dense.starting(layers, 1))
    slope = dense._flat(dense.gradients(dense._shaped(flat, layers), x, y)[0])
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        ends = [dense.gradients(dense._shaped(flat + s, layers), x, y)[1][0] for s in (step, -step)]
        assert abs((ends[0] - ends[1]) / 2e-6 - slope[i]) < 1e-4


def test_ten_steps_equal_one_machine(spark):
    df = frame(spark)
    layers = [4, 8, 6, 3]
    settings = dict(epochs=5, batch=200, rate=0.01)
    model = DenseNetwork(layers, **settings).fit(df.repartition(5))
    rows = df.select("x", F.col("label").cast("int").alias("y"), F.pmod(F.xxhash64("x", F.col("label").cast("int"), F.lit(42)), F.lit(2)).alias("b")).collect()
    flat = dense._flat(dense.starting(layers, 42))
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
    losses = []
    for epoch in range(5):
        told = np.zeros(3)
        for b in np.random.default_rng([42, epoch]).permutation(2):
            mine = [r for r in rows if r.b == b]
            weights = dense._shaped(flat, layers)
            slope, seen = 0, np.zeros(3)
            for r in mine:  # one row after the other
                found, one = dense.gradients(weights, np.array([r.x]), np.array([r.y]))
                slope, seen = slope + dense._flat(found), seen + one
            step += 1
            slope = slope / len(mine)
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            flat = flat - 0.01 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-7)
            told += seen
        losses.append(told[0] / told[2])
    assert step == 10 and np.allclose(model.flat, flat, atol=1e-9)
    assert np.allclose([h[1] for h in model.history], losses)


def test_it_learns_and_keeps_a_history(spark):
    df = frame(spark, 900).withColumn("held", F.col("key") % 5 == 0)
    model = DenseNetwork([4, 32, 32, 3], epochs=25, batch=128, rate=0.01, validation="held").fit(df)
    first, last = model.history[0], model.history[-1]
    assert len(model.history) == 25 and last[1] < first[1] and last[2] > 0.85 and last[4] > 0.75
    scored = model.transform(df.where("held"))
    right = scored.where("label = prediction").count() / scored.count()
    assert abs(right - last[4]) < 1e-9
    path = scratch_path(spark, "dense")
    model.save(spark, path)
    assert sorted(DenseModel.load(spark, path).transform(df).select("key", "prediction").collect()) == sorted(model.transform(df).select("key", "prediction").collect())


def test_an_epoch_is_a_few_jobs_however_many_steps_it_takes(spark):
    context = spark.sparkContext
    context.setJobGroup("dense", "dense")
    try:
        model = DenseNetwork([4, 8, 3], epochs=2, batch=10, rate=0.01).fit(frame(spark, 600))
        jobs = context.statusTracker().getJobIdsForGroup("dense")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20 and len(model.history) == 2


def test_a_batch_with_many_copies_is_taken_in_pieces(spark, monkeypatch):
    df = frame(spark, 60).unionByName(frame(spark, 1).crossJoin(spark.range(300)).drop("id"))
    whole = DenseNetwork([4, 8, 3], epochs=3, batch=40, rate=0.01).fit(df)
    monkeypatch.setattr(dense, "ROWS_AT_ONCE", 7)
    pieces = DenseNetwork([4, 8, 3], epochs=3, batch=40, rate=0.01).fit(df.repartition(6))
    assert np.allclose(whole.flat, pieces.flat, atol=1e-9)


def test_a_history_with_held_rows_takes_two_jobs_an_epoch(spark):
    df = frame(spark, 500).withColumn("held", F.col("key") % 5 == 0)
    context, jobs = spark.sparkContext, []
    for epochs in (1, 4):
        context.setJobGroup(f"history {epochs}", "history")
        try:
            model = DenseNetwork([4, 8, 3], epochs=epochs, batch=20, rate=0.01, validation="held").fit(df)
            jobs.append(len(context.statusTracker().getJobIdsForGroup(f"history {epochs}")))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 3 * 4 and len(model.history) == 4
    assert all(0 < h[3] < 5 and 0 <= h[4] <= 1 for h in model.history)
