import math

import numpy as np

from tidewatch.operators.isolation import IsolationForest, IsolationForestModel
from tidewatch.session import scratch_path


def depth(tree, row):
    feature, cut, ends = tree
    place = 0
    while feature[place] >= 0:
        value = row[feature[place]]
        place = 2 * place + (1 if value is not None and value <= cut[place] else 2)
    return ends[place]


def usual(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def frame(spark, count=3000, planted=30, seed=2):
    pick = np.random.default_rng(seed)
    x = pick.standard_normal((count, 3))
    x[:planted] += pick.choice([-9, 9], (planted, 3))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, a double, b double, `c d` double"), x


def test_scores_equal_the_plain_definition_and_find_planted_rows(spark):
    df, x = frame(spark)
    model = IsolationForest(["a", "b", "c d"], trees=50, share=0.01).fit(df)
    got = {r.key: r for r in model.transform(df).collect()}
    for i in range(0, 3000, 37):
        mean = sum(depth(t, x[i]) for t in model.forest) / 50
        assert abs(got[i].outlier_score - 2 ** (-mean / usual(256))) < 1e-9
    assert {k for k, r in got.items() if r.is_outlier} == set(range(30))
    clipped = {r.key: (r.a, r.b, r["c d"]) for r in model.clip(df).collect()}
    usual_rows = x[30:]
    for i in range(3000):
        expected = np.clip(x[i], usual_rows.min(0), usual_rows.max(0)) if i < 30 else x[i]
        assert np.allclose(clipped[i], expected)


def test_every_leaf_holds_what_its_sample_says(spark):
    df, x = frame(spark, 100, 5)
    model = IsolationForest(["a", "b", "c d"], trees=3, sample=64).fit(df.repartition(5))
    again = IsolationForest(["a", "b", "c d"], trees=3, sample=64).fit(df.coalesce(1))
    for one, other in zip(model.forest, again.forest):
        assert all((a == b).all() for a, b in zip(one, other))
    for feature, _, ends in model.forest:
        assert len(feature) == 127 and (ends[feature >= 0] == 0).all()


def test_edges(spark):
    schema = "key long, a double, b double"
    rows = [(1, 1.0, None), (2, 1.0, float("nan")), (3, float("inf"), 2.0), (4, None, None), (4, None, None)]
    df = spark.createDataFrame(rows, schema)
    model = IsolationForest(["a", "b"], trees=5, share=0.2).fit(df)
    assert model.transform(df).where("outlier_score IS NULL").count() == 0 and model.clip(df).count() == 5
    nothing = df.where("key < 0")
    assert IsolationForest(["a", "b"], trees=5, share=0.2).fit(nothing).transform(nothing).count() == 0
    same = spark.createDataFrame([(i, 2.0, 3.0) for i in range(20)], schema)
    assert IsolationForest(["a", "b"], trees=5, share=0.1).fit(same).transform(same).where("is_outlier").count() == 0
    path = scratch_path(spark, "isolation")
    model.save(spark, path)
    answers = [sorted(m.transform(df).select("key", "outlier_score", "is_outlier").collect()) for m in (model, IsolationForestModel.load(spark, path))]
    assert answers[0] == answers[1]


def test_a_fit_works_the_scores_out_once(spark):
    from pyspark.sql import functions as F

    df, _ = frame(spark, 2000, 20)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    read = df.withColumn("a", counted.asNondeterministic()("a"))
    model = IsolationForest(["a", "b", "c d"], trees=10, share=0.01).fit(read)
    assert seen.value <= 2 * 2000 and model.limit > 0.5
