"""Fits, ensembles, persistence, error isolation and the stream."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewatch.models import classifiers, ensembles, training
from tidewatch.models.boosting import BoostingModel, HistogramBoosting
from tidewatch.models.extra_trees import ExtraTrees, ExtraTreesModel
from tidewatch.models.kernel_svm import KernelClassifier
from tidewatch.operators import splits
from tidewatch.plans import catalog, experiments, modelling
from tidewatch.session import scratch_path
from tidewatch.streaming.detect import detections


@pytest.fixture(scope="module")
def rows(spark):
    """Three noisy blobs, of which one surrounds the others, plus a constant column."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.4, (150, 2)), rng.normal(2, 0.4, (150, 2))
    angle = rng.uniform(0, 2 * np.pi, 150)
    c = np.stack([1 + 4 * np.cos(angle), 1 + 4 * np.sin(angle)], axis=1) + rng.normal(0, 0.2, (150, 2))
    x = np.concatenate([a, b, c])
    data = [(i, i // 150, [float(v) for v in row] + [1.0]) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "key long, y int, x array<double>")
    out = df.select("key", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"))
    return splits.split(out, "key", "label", val_size=0.1).persist()


def part(rows, name, classes=3):
    return rows.where((F.col("split") == name) & (F.col("label") < classes))


def accuracy(model, rows):
    return model.transform(rows).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]


def test_extra_trees_learn_and_survive_saving(spark, rows):
    model = ExtraTrees(15, 8).fit(part(rows, "train"))
    test = part(rows, "test")
    assert accuracy(model, test) > 0.93
    assert model.importances[2] == 0 and abs(model.importances.sum() - 1) < 1e-9
    shares = model.transform(test).select(vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in shares)
    path = scratch_path(spark, "trees")
    model.save(spark, path)
    again = ExtraTreesModel.load(spark, path).transform(test).select("key", "prediction").collect()
    assert sorted(again) == sorted(model.transform(test).select("key", "prediction").collect())


def test_extra_trees_fit_every_row_when_deep(rows):
    model = ExtraTrees(3, 20).fit(part(rows, "train"))
    assert accuracy(model, part(rows, "train")) == 1.0


def test_boosting_of_three_classes(spark, rows):
    model = HistogramBoosting(3, rounds=12, depth=3, rate=0.3).fit(part(rows, "train"))
    test = part(rows, "test")
    assert accuracy(model, test) > 0.9
    path = scratch_path(spark, "boosting")
    model.save(spark, path)
    assert accuracy(BoostingModel.load(spark, path), test) == accuracy(model, test)


def test_kernel_model_separates_a_ring(rows):
    train, test = part(rows, "train"), part(rows, "test")
    assert accuracy(KernelClassifier(100, iterations=50).fit(train), test) > 0.9


@pytest.mark.parametrize("classes", [2, 3])
def test_kernel_model_is_the_logistic_one_on_lifted_rows_without_storing_them(spark, rows, monkeypatch, classes):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import DataFrame

    train, test = part(rows, "train", classes), part(rows, "test", classes)
    persisted = []
    real = DataFrame.persist
    monkeypatch.setattr(type(train), "persist", lambda self, *a: (persisted.append(self.columns), real(self, *a))[1])
    model = KernelClassifier(20, penalty=1e-2).fit(train)
    assert not persisted
    plain = LogisticRegression(featuresCol="__lifted", regParam=1e-2, maxIter=1000, tol=1e-12).fit(model.lift(train))
    one, other = ({r.key: r.p for r in m.transform(model.lift(test)).select("key", vector_to_array("probability").alias("p")).collect()} for m in (model.linear, plain))
    assert all(np.allclose(one[k], other[k], atol=2e-3) for k in one) and len(one) == test.count()


def test_neighbour_model(rows):
    model = classifiers.NearestNeighbors("key", 5).fit(part(rows, "train"))
    out = model.transform(part(rows, "test"))
    assert accuracy(model, part(rows, "test")) > 0.93
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in out.select(vector_to_array("probability").alias("p")).collect())


def test_one_failing_model_does_not_stop_the_others(rows):
    class Broken:
        def fit(self, df):
            raise RuntimeError("no luck")

    trained = training.train_all(
        {"broken": Broken(), "bayes": classifiers.naive_bayes(), "svm": classifiers.linear_svm(2, 20)},
        part(rows, "train", 2), part(rows, "test", 2), "blobs")
    assert list(trained.models) == ["bayes", "svm"] and "no luck" in trained.errors["broken"]
    by_name = {r[1]: r for r in trained.rows}
    assert by_name["bayes"][7] == 1.0 and by_name["svm"][7] is None  # no probabilities, no area
    assert trained.best() == "bayes"


def test_models_of_a_run_are_fitted_side_by_side(rows):
    import threading

    both = threading.Barrier(2, timeout=60)

    class Meeting:
        def fit(self, df):
            both.wait()
            return classifiers.naive_bayes().fit(df)

    trained = training.train_all({"a": Meeting(), "b": Meeting()}, part(rows, "train", 2), part(rows, "test", 2), "blobs")
    assert not trained.errors and [(r[1], r[8]) for r in trained.rows] == [("a", 0), ("b", 1)]


def test_a_model_scoring_zero_is_never_best():
    trained = training.Trained(rows=[("d", "m", 0.0, 0.0, 0.0, 0.0, 0.0, None, 0)])
    assert trained.best() is None


def test_ensembles(rows):
    members = {"tree": classifiers.decision_tree(4), "bayes": classifiers.naive_bayes()}
    train, val, test = part(rows, "train"), part(rows, "val"), part(rows, "test")
    soft = ensembles.VotingEnsemble(members, "soft", [1.0, 2.0], 3).fit(train)
    assert accuracy(soft, test) > 0.9
    assert soft.optimise(val, trials=10) > 0.8 and abs(sum(soft.weights) - 1) < 1e-9
    assert accuracy(ensembles.VotingEnsemble(members, "hard", None, 3).fit(train), test) > 0.85
    stacked = ensembles.StackingEnsemble(members, "fold", 3, 3, 50).fit(splits.folds(train, "key", "label", 3))
    assert accuracy(stacked, test) > 0.9
    scores = training.cross_validate(
        ensembles.VotingEnsemble(members, "soft", None, 3), splits.folds(train, "key", "label", 3), "fold", 3)
    assert len(scores["scores"]) == 3 and abs(scores["mean"] - np.mean(scores["scores"])) < 1e-12


def test_search_spaces_can_be_drawn_from(rows):
    from tidewatch import fixed_values as fixed

    forest = classifiers.random_forest(2, 2)
    space = fixed.SEARCH_SPACES["random_forest"]
    assert len(training.parameter_grid(forest, space)) == 54
    assert len(training.parameter_grid(forest, space, draws=5)) == 5


def test_stream_equals_batch(spark, folder):
    streamed = {r.flow_id: r.prediction for r in catalog.QUERIES["stream_detect"](spark, folder).collect()}
    fitted, prepared = modelling.prepared_flows(spark, folder)
    scaled = experiments.split_and_scale(prepared)
    model = scaled.scorer(classifiers.naive_bayes().fit(scaled.part("train")))
    names = {c: f"f{i}" for i, c in enumerate(prepared.features)}

    def features(df):
        made = fitted.transform(df).withColumn("key", F.col("flow_id"))
        return made.select("key", F.lit(0.0).alias("label"), F.lit("new").alias("split"),
                           *[F.col(c).cast("double").alias(n) for c, n in names.items()])

    from tidewatch.plans.derived import flows

    batch = detections(flows(spark, folder), features, model, ["key"]).collect()
    assert {r.key: r.prediction for r in batch} == streamed
    assert all(0 <= r.attack_probability <= 1 and r.confidence >= 0.5 for r in batch)


@pytest.mark.parametrize("name", ["recursive_elimination", "training_history"])
def test_runs_give_rows(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0


def test_a_whole_run_has_a_row_for_each_model_and_saves_the_best(spark, folder, monkeypatch):
    from tidewatch.models.saved import Scorer

    few = {"Naive Bayes": classifiers.naive_bayes(), "Decision Tree": classifiers.decision_tree(5)}
    monkeypatch.setattr(classifiers, "standard_models", lambda *a, **k: dict(few))
    monkeypatch.setattr(modelling, "PATIENCE", 1)
    rows = catalog.QUERIES["cyber_run"](spark, folder).collect()
    assert {r.model for r in rows} == {*few, "Category Boosting"} and all(0 <= r.f1 <= 1 for r in rows)
    assert sorted(catalog.QUERIES["cyber_run"](spark, folder).collect()) == sorted(rows)
    modelling._run_rows.cache_clear()
    prepared, _ = modelling.wsn_rows(spark, folder)
    path = scratch_path(spark, "best")
    trained, scaled = experiments.run(prepared, few, "macro", path)
    test = scaled.part("test")
    raw = prepared.data.select("key", F.col("target").cast("double").alias("label"), F.lit("new").alias("split"),
                               *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(prepared.features)]).join(test.select("key"), "key")
    best = trained.models[trained.best()].transform(test).select("key", "prediction").collect()
    assert sorted(Scorer.load(spark, path).transform(raw).select("key", "prediction").collect()) == sorted(best)


def test_a_run_raises_what_failed(spark, folder, monkeypatch):
    class Broken:
        def fit(self, df):
            raise RuntimeError("no luck")

    monkeypatch.setattr(classifiers, "standard_models", lambda *a, **k: {"Broken": Broken()})
    with pytest.raises(RuntimeError, match="no luck"):
        modelling.wsn_experiment(spark, folder)


def test_extra_trees_do_not_depend_on_layout_or_rounds(spark, monkeypatch):
    from tidewatch.models import extra_trees

    rows = [([float(i * 7 % 31), float(i % 5), float(i * i % 17), 1.0, 2.0], (i * 3 % 11) // 4) for i in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label int").select(array_to_vector("x").alias("features"), "label")

    def nodes(parts):
        found = extra_trees.ExtraTrees(5, 5, 1).fit(df.repartition(parts)).nodes
        return sorted(zip(found["tree"], found["feature"], found["threshold"], found["shares"].map(tuple)))

    whole = nodes(1)
    monkeypatch.setattr(extra_trees, "SLOTS_PER_ROUND", 60)
    monkeypatch.setattr(extra_trees, "STORED_EVERY", 2)
    assert nodes(6) == whole and len(whole) > 40


@pytest.mark.parametrize("width", [2, 7])
def test_extra_trees_grown_by_tasks_alone_are_those_grown_by_levels(spark, monkeypatch, width):
    from tidewatch.models import extra_trees

    pick = np.random.default_rng(width)
    x = np.round(pick.normal(size=(500, width)), 1)
    x[:, 0] = 1.0
    y = (x[:, 1] > 0.2).astype(int) + (pick.random(500) < 0.2)
    df = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "x array<double>, label int").select(array_to_vector("x").alias("features"), "label")
    context = spark.sparkContext
    context.setJobGroup(f"alone {width}", "alone")
    try:
        alone = ExtraTrees(6, 9, 3).fit(df)
        assert len(context.statusTracker().getJobIdsForGroup(f"alone {width}")) < 18
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(extra_trees, "LOCAL_VALUES", 0)
    levels = ExtraTrees(6, 9, 3).fit(df.repartition(4))
    assert len(alone.nodes) > 100 and alone.nodes.equals(levels.nodes) and np.allclose(alone.importances, levels.importances)


def test_extra_trees_equal_a_plain_version(spark, rows):
    from tidewatch.models import extra_trees

    train = part(rows, "train").select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r.x for r in train]), np.array([int(r.label) for r in train])
    model = ExtraTrees(3, 6, 7).fit(part(rows, "train"))
    tried = int(np.sqrt(x.shape[1]))

    def grow(tree, place, at, depth):
        counts = np.bincount(y[at], minlength=3)
        if depth < 6 and np.count_nonzero(counts) > 1:
            key = np.array([(tree << 32) | place])
            order = np.argsort(extra_trees._draws(7, key, x.shape[1])[0], kind="stable")
            for start in range(0, x.shape[1], tried):
                best = None
                for f in order[start: start + tried]:
                    low, high = x[at, f].min(), x[at, f].max()
                    if high > low:
                        cut = low + extra_trees._draws(8, key, x.shape[1])[0][f] * (high - low)
                        left = at[x[at, f] <= (low if cut >= high else cut)]
                        right = np.setdiff1d(at, left)
                        cost = sum(len(s) - (np.bincount(y[s], minlength=3) ** 2).sum() / len(s) for s in (left, right))
                        if best is None or cost < best[0]:
                            best = (cost, f, cut, left, right)
                if best:
                    return [(tree, int(best[1]), round(best[2], 9)), *grow(tree, 2 * place, best[3], depth + 1), *grow(tree, 2 * place + 1, best[4], depth + 1)]
        return [(tree, -1, 0.0)]

    expected = sorted(n for t in range(3) for n in grow(t, 1, np.arange(len(x)), 0))
    assert sorted((int(t), int(f), round(float(c), 9)) for t, f, c in zip(model.nodes["tree"], model.nodes["feature"], model.nodes["threshold"])) == expected


def test_samples_of_a_folder_are_exact_per_file(spark, tmp_path):
    from tidewatch.sources import readers

    for name, n in (("a", 100), ("b", 40)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{i % 7},{name}\n" for i in range(n)))
    (tmp_path / "c.csv").write_text("\n")
    got = readers.read_csv_folder(spark, str(tmp_path), default_type="string", sample_frac=0.25).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {"a": 25, "b": 10}
    skipped = readers.skipped_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.problem) for r in skipped] == [("c.csv", "empty")]


def test_repeated_sensor_ids_do_not_multiply_rows(spark, tmp_path):
    from tidewatch import fixed_values as fixed
    from tidewatch.plans import experiments

    names = ["id", *fixed.WSN_FEATURES, "Attack type"]
    rows = "".join(f"{i % 10}," + ",".join(str(i + j) for j in range(len(names) - 2)) + f",{'Normal' if i % 2 else 'Flooding'}\n" for i in range(60))
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + rows)
    prepared = experiments.prepare_wsn(spark, str(tmp_path / "w.csv"))
    assert prepared.data.count() == 60 == prepared.data.select("key").distinct().count()


def test_headers_come_from_one_job_that_reads_the_starts(spark, tmp_path):
    from tidewatch.sources import readers

    folder = tmp_path / "with space"
    folder.mkdir()
    for i in range(60):
        (folder / f"f {i}.csv").write_text(f'"a, {i % 3}",b\n' if i else "\n  \n" * 40 + "x,y\n1,2\n")
    (folder / "blank.csv").write_text("\n \n")
    (folder / "other.txt").write_text("no,csv\n")
    (folder / "long.csv").write_text("p,q\n" + "1,2\n" * 400_000)
    context = spark.sparkContext
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    context.setJobGroup("headers", "headers")
    try:
        found = readers.csv_headers(spark, str(folder))
        jobs = context.statusTracker().getJobIdsForGroup("headers")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    headers = {p.rsplit("/", 1)[1]: (h, problem) for p, h, problem in found}
    assert len(jobs) == 1 and len(found) == 62
    assert headers["blank.csv"] == (None, "empty") and headers["f 0.csv"] == (("x", "y"), "") and headers["f 7.csv"] == (("a, 1", "b"), "")
    assert headers["long.csv"] == (("p", "q"), "")
    assert before == {k: spark.conf.get(k) for k in before}
    whole = readers.read_csv_folder(spark, str(folder), default_type="string")
    assert whole.count() == 400_001 and set(whole.columns) == {"a,_0", "a,_1", "a,_2", "b", "x", "y", "p", "q"}


def test_a_file_that_cannot_be_read_is_an_error(spark, tmp_path):
    from tidewatch.sources import readers

    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv.gz").write_bytes(b"\x1f\x8b\x08\x00broken")
    with pytest.raises(Exception):
        readers.csv_headers(spark, str(tmp_path), "*.csv*")
