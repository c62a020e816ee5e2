"""Queries: fitted models, ensembles, validation, whole runs and the stream."""

from __future__ import annotations

import functools
import math
import time

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import fixed_values as fixed
from tidewatch.models import classifiers, ensembles, inspect, search, training
from tidewatch.models.kernel_svm import KernelClassifier
from tidewatch.models.saved import Scorer
from tidewatch.operators import metrics, select, splits
from tidewatch.operators.compare import published_gap
from tidewatch.operators.encode import fit_scaler
from tidewatch.operators.features import fit_log_features
from tidewatch.plans import cleaning, derived, experiments
from tidewatch.plans.cleaning import LINE_NUMBERS
from tidewatch.plans.derived import FLOWS_SQL, flows
from tidewatch.plans.evaluating import DETECTION, SUMMARY, detection_sql
from tidewatch.plans.preparing import _HASH, PORT_SQL, SUBNET_SQL, TEXT_SQL, TIME_SQL, address_sql, split_sql
from tidewatch.plans.neighborhood import KNN_VOTES
from tidewatch.plans.registry import query, rounded, table
from tidewatch.session import cut_lineage, scratch_path
from tidewatch.sources.writers import load_model, save_model, save_results
from tidewatch.streaming.detect import detections, read_new_files, write_available


# --- Gaussian naive Bayes, restated in SQL ----------------------------------

def bayes_sql(rows: str, features: list[str], key: str = "key", scored: str = "split = 'test'") -> str:
    """Predictions of a Gaussian naive Bayes fitted on ``split = 'train'``; ``rows`` has key, y, split and the features."""
    names = ", ".join(features)
    return f"""
    SELECT key, y, cls::int AS pred FROM (
        WITH s AS (SELECT {key} AS key, y, split, {names} FROM ({rows})),
        l AS (SELECT key, y, split, f, x FROM (SELECT key, y, split, {', '.join(f'cast({c} AS double) AS {c}' for c in features)} FROM s)
              UNPIVOT (x FOR f IN ({names}))),
        m AS (SELECT y AS cls, f, avg(x) AS mean, var_pop(x) AS var FROM l WHERE split = 'train' GROUP BY ALL),
        e AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(x) AS v FROM l WHERE split = 'train' GROUP BY f)),
        p AS (SELECT y AS cls, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM s WHERE split = 'train' GROUP BY y)
        SELECT l.key, any_value(l.y) AS y, m.cls, any_value(prior) + sum(-0.5 * ln(2 * {math.pi!r} * (var + eps)) - (x - mean) * (x - mean) / (2 * (var + eps))) AS score
        FROM l JOIN m USING (f) JOIN p USING (cls), e WHERE l.{scored} GROUP BY l.key, m.cls)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, cls) = 1"""


_VECTOR_NAMES = [f"v{i}" for i in range(64)]
_VECTOR_ROWS = split_sql(
    "SELECT vec_id, label, " + ", ".join(f"cast(embedding[{i + 1}] AS double) AS v{i}" for i in range(64)) + " FROM embeddings",
    "vec_id", "label", val=0.0)


def embedded(spark, folder):
    """Embeddings as vectors with an exact 80/20 split."""
    rows = splits.split(table(spark, folder, "embeddings"), "vec_id", "label", val_size=0)
    from pyspark.ml.functions import array_to_vector

    return rows.select(
        "vec_id", F.col("vec_id").alias("key"), F.col("label").cast("double").alias("label"), "split",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@query("gaussian_nb", f"""
    SELECT key AS vec_id, y AS label, pred AS prediction FROM ({bayes_sql(f"SELECT *, label AS y FROM ({_VECTOR_ROWS})", _VECTOR_NAMES, "vec_id")})""")
def gaussian_nb(spark, folder):
    """Ten classes, 64 numbers per row."""
    rows = embedded(spark, folder)
    model = classifiers.naive_bayes().fit(rows.where("split = 'train'"))
    scored = model.transform(rows.where("split = 'test'"))
    return scored.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


# --- the flagship: raw flows to detection metrics ---------------------------

_FLOW_LABELS = f"""
    SELECT *, CASE WHEN lower(trim(raw_label)) IN ('benign', 'normal') THEN 0 ELSE 1 END AS target FROM ({FLOWS_SQL})"""
_FLOW_TABLE = f"""
    WITH f AS ({_FLOW_LABELS}), m AS (SELECT quantile_cont(anomaly_score, 0.5) AS md FROM f),
    g AS (SELECT * REPLACE (CASE WHEN anomaly_score IS NULL OR isinf(anomaly_score) THEN md ELSE anomaly_score END AS anomaly_score),
                 (dense_rank() OVER (ORDER BY trim(coalesce(protocol, 'Unknown'))) - 1)::int AS protocol_encoded FROM f, m)
    SELECT flow_id, target, src_port, dst_port, anomaly_score, protocol_encoded, {PORT_SQL}, {TIME_SQL}, {address_sql('src_ip', 'src_ip')},
           {address_sql('dst_ip', 'dst_ip')}, {SUBNET_SQL}, {TEXT_SQL} FROM g"""
_FLOW_SPLIT = split_sql(_FLOW_TABLE, "flow_id", "target")
_SCALED = ", ".join(
    f"(cast({c} AS double) - avg({c}) FILTER (split = 'train') OVER ()) / (CASE stddev_pop({c}) FILTER (split = 'train') OVER () "
    f"WHEN 0 THEN 1 ELSE stddev_pop({c}) FILTER (split = 'train') OVER () END) AS {c}" for c in experiments.FLOW_FEATURES)
_FLOW_ROWS = f"SELECT flow_id, target AS y, split, {_SCALED} FROM ({_FLOW_SPLIT})"


def prepared_flows(spark, folder):
    labelled = cleaning.add_flow_labels(flows(spark, folder))
    fitted = fit_log_features(labelled, experiments.FLOW_COLUMNS)
    made = fitted.transform(labelled).withColumn("key", F.col("flow_id"))
    return fitted, experiments.Prepared(made, experiments.FLOW_FEATURES, 2, "flows")


@query("flow_detect_e2e", detection_sql(bayes_sql(_FLOW_ROWS, experiments.FLOW_FEATURES, "flow_id")))
def flow_detect_e2e(spark, folder):
    """Repair, features, labels, exact split, scaling on training rows, naive Bayes, detection metrics."""
    _, prepared = prepared_flows(spark, folder)
    scaled = experiments.split_and_scale(prepared)
    model = classifiers.naive_bayes().fit(scaled.part("train"))
    counts = metrics.confusion(model.transform(scaled.part("test")), "label", "prediction")
    return rounded(metrics.detection_scores(counts), DETECTION)


@query("stream_detect", f"SELECT key AS flow_id, pred AS prediction FROM ({bayes_sql(_FLOW_ROWS, experiments.FLOW_FEATURES, 'flow_id', 'split IS NOT NULL')})")
def stream_detect(spark, folder):
    """The same model applied to the events as a stream of files; every flow gets a prediction."""
    fitted, prepared = prepared_flows(spark, folder)
    scaled = experiments.split_and_scale(prepared)
    model = scaled.scorer(classifiers.naive_bayes().fit(scaled.part("train")))
    saved = load_model(save_model(model, scratch_path(spark, "model")))
    names = {c: f"f{i}" for i, c in enumerate(experiments.FLOW_FEATURES)}

    def features(rows):
        made = fitted.transform(rows).withColumn("key", F.col("flow_id"))
        slim = made.select("key", F.lit(0.0).alias("label"), F.lit("new").alias("split"), *[F.col(c).cast("double").alias(n) for c, n in names.items()])
        return slim

    raw = read_new_files(spark, folder, table(spark, folder, "events").schema, "events.parquet")
    stream = raw.selectExpr(*[f"{e} as `{n}`" for n, e in derived.FLOWS.items()])
    path = write_available(detections(stream, features, saved, ["key"]), scratch_path(spark, "detections"))
    return spark.read.parquet(path).select(F.col("key").alias("flow_id"), "prediction")


# --- model fits (no SQL twin: training is not expressible) -------------------

def lines(spark, folder):
    """All line items: three classes and four scaled numbers, split 80/20 by a content key."""
    raw = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), *LINE_NUMBERS)
    keyed = splits.with_content_key(raw, "key").withColumn("label", F.expr("CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"))
    rows = splits.split(keyed, "key", "label", val_size=0)
    scaled = fit_scaler(rows.where("split = 'train'"), LINE_NUMBERS).transform(rows)
    return VectorAssembler(inputCols=LINE_NUMBERS, outputCol="features").transform(scaled).select(
        "key", F.col("label").cast("double").alias("label"), "split", "features")


def wsn_rows(spark, folder, binary=True):
    """Sensor readings from their CSV files, cleaned, split and scaled."""
    prepared = experiments.prepare_wsn(spark, cleaning.write_wsn(spark, folder), cleaning.wsn_schema(), binary)
    return prepared, experiments.split_and_scale(prepared)


_WSN_CLASS = f"SELECT id, {cleaning.WSN_CATEGORY} AS attack_category FROM ({derived.from_events(derived.WSN)})"
_WSN_BINARY = f"SELECT id, CASE attack_category WHEN 'Normal' THEN 0 ELSE 1 END AS target FROM ({_WSN_CLASS})"
_WSN_MULTI = f"SELECT id, dense_rank() OVER (ORDER BY attack_category) - 1 AS target FROM ({_WSN_CLASS})"


def tested_sql(rows: str, learnt: bool = True) -> str:
    """Per true class how many rows are in the test part; all have a known class predicted and chances that add up to one.

    With ``learnt`` the labels can be told from the features, so more answers are right than if the largest class were always answered.
    """
    more = ", true AS beats_majority" if learnt else ""
    return f"""
    SELECT target::int AS label, count(*) AS tested, true AS class_known, true AS chances_add_up{more}
    FROM ({rows}) WHERE split = 'test' GROUP BY target"""


TESTED_BINARY, TESTED_MULTI = (tested_sql(split_sql(t, "id", "target")) for t in (_WSN_BINARY, _WSN_MULTI))


def tested(scored, classes, learnt=True):
    """What of a model's test can be restated without the model: the rows of each true class, and whether the answers are sound and better than the largest class."""
    known = (F.col("prediction") >= 0) & (F.col("prediction") < classes) & (F.col("prediction") == F.floor("prediction"))
    whole = F.lit(True)
    if "probability" in scored.columns:
        whole = F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6
    found = scored.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("tested"), F.bool_and(known).alias("class_known"), F.bool_and(whole).alias("chances_add_up"),
        F.count_if(F.col("prediction") == F.col("label")).alias("right"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    better = F.sum("right").over(every) > F.max("tested").over(every)
    return (found.withColumn("beats_majority", better) if learnt else found).drop("right")


#: Rounds of boosting without a better one on the validation rows that end a fit.
PATIENCE = 10


def with_held_rows(scaled):
    """Training and validation rows, the latter marked ``held``."""
    return scaled.rows.where("split <> 'test'").withColumn("held", F.col("split") == "val")


def tested_by(estimator, prepared, scaled):
    return tested(estimator.fit(scaled.part("train")).transform(scaled.part("test")), prepared.classes)


@query("decision_tree", TESTED_BINARY)
def decision_tree(spark, folder):
    return tested_by(classifiers.decision_tree(), *wsn_rows(spark, folder))


@query("random_forest", TESTED_MULTI)
def random_forest(spark, folder):
    return tested_by(classifiers.random_forest(), *wsn_rows(spark, folder, binary=False))


@query("linear_svm", TESTED_BINARY)
def linear_svm(spark, folder):
    return tested_by(classifiers.linear_svm(2), *wsn_rows(spark, folder))


@query("linear_svm_multiclass", TESTED_MULTI)
def linear_svm_multiclass(spark, folder):
    prepared, scaled = wsn_rows(spark, folder, binary=False)
    return tested_by(classifiers.linear_svm(prepared.classes), prepared, scaled)


@query("kernel_svm", TESTED_BINARY)
def kernel_svm(spark, folder):
    return tested_by(KernelClassifier(), *wsn_rows(spark, folder))


@query("extra_trees", TESTED_MULTI)
def extra_trees(spark, folder):
    return tested_by(classifiers.extra_trees(), *wsn_rows(spark, folder, binary=False))


@query("boosted_trees", TESTED_BINARY)
def boosted_trees(spark, folder):
    """Up to 200 rounds of depth 7; the validation rows choose the number and end the fit ``PATIENCE`` rounds after the best one."""
    prepared, scaled = wsn_rows(spark, folder)
    model = classifiers.boosted_trees(validation="held", patience=PATIENCE).fit(with_held_rows(scaled))
    return tested(model.transform(scaled.part("test")), prepared.classes)


@query("boosted_categories")
def boosted_categories(spark, folder):
    """Raw categories next to numbers; validation rows decide how many rounds are kept."""
    prepared = experiments.prepare_cyber(spark, cleaning.write_cyber(spark, folder), cleaning.CYBER_SCHEMA, binary=False)
    _, scored = experiments.boost_raw_categories(prepared, patience=PATIENCE)
    return rounded(metrics.summary_scores(metrics.confusion(scored, "label", "prediction")), SUMMARY)


@query("mlp", TESTED_MULTI)
def mlp(spark, folder):
    prepared, scaled = wsn_rows(spark, folder, binary=False)
    return tested_by(classifiers.dense_network(len(prepared.features), prepared.classes, "vgg16"), prepared, scaled)


@query("knn_model", KNN_VOTES)
def knn_model(spark, folder):
    """The model of the vote: the same answers as ``knn_vote``."""
    rows = embedded(spark, folder)
    model = classifiers.NearestNeighbors("key", 5).fit(rows.where("split = 'train'"))
    scored = model.transform(rows.where("split = 'test'"))
    return scored.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def _members():
    return {"forest": classifiers.random_forest(10, 6), "boosted": classifiers.boosted_trees(2, 5, 4), "bayes": classifiers.naive_bayes()}


@query("voting", TESTED_BINARY)
def voting(spark, folder):
    return tested_by(ensembles.VotingEnsemble(_members()), *wsn_rows(spark, folder))


@query("weighted_ensemble", TESTED_BINARY)
def weighted_ensemble(spark, folder):
    """Weights found on the validation rows, applied to the test rows."""
    prepared, scaled = wsn_rows(spark, folder)
    model = ensembles.VotingEnsemble(_members()).fit(scaled.part("train"))
    model.optimise(scaled.part("val"), trials=100)
    return tested(model.transform(scaled.part("test")), prepared.classes)


@query("stacking", TESTED_BINARY)
def stacking(spark, folder):
    prepared, scaled = wsn_rows(spark, folder)
    train = splits.folds(scaled.part("train"), "key", "label", 5)
    members = {"tree": classifiers.decision_tree(6), "forest": classifiers.random_forest(10, 6), "bayes": classifiers.naive_bayes()}
    model = ensembles.StackingEnsemble(members, "fold", 5, iterations=50).fit(train)
    return tested(model.transform(scaled.part("test")), prepared.classes)


@query("cross_validation", f"""
    WITH t AS (SELECT * FROM ({split_sql(_WSN_BINARY, 'id', 'target')}) WHERE split = 'train'),
    f AS (SELECT cast(((row_number() OVER (PARTITION BY target ORDER BY {_HASH.format(key='id')}) - 1) * 5) // count(*) OVER (PARTITION BY target) AS int) AS fold FROM t)
    SELECT fold, count(*) AS tested, true AS score_sound FROM f GROUP BY fold""")
def cross_validation(spark, folder):
    """Each training row is scored once, by the model of the other folds."""
    _, scaled = wsn_rows(spark, folder)
    rows = splits.folds(scaled.part("train"), "key", "label", 5)
    found = training.cross_validate(classifiers.decision_tree(), rows, "fold", 5)
    scores = spark.createDataFrame([(i, 0 <= s <= 1) for i, s in enumerate(found["scores"])], "fold int, score_sound boolean")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("tested")).join(scores, "fold")


#: Settings drawn for the registered search, folds, and the least rows of a sample.
SEARCH_DRAWS, SEARCH_FOLDS, SEARCH_LEAST = 9, 2, 500


@query("parameter_search", f"""
    WITH t AS (SELECT target, count(*) AS n FROM ({split_sql(_WSN_BINARY, 'id', 'target')}) WHERE split = 'train' GROUP BY target),
    r AS (SELECT * FROM (VALUES (0, {SEARCH_DRAWS}, 3), (1, 3, 1)) AS v(rung, settings, part)),
    s AS (SELECT rung, settings, least(1.0::double, greatest(1.0::double / part, {SEARCH_LEAST}.0::double / (SELECT sum(n) FROM t))) AS share FROM r)
    SELECT rung, settings, cast(sum(round_even(share * n, 0)) AS bigint) AS sampled, true AS sound, true AS learnt FROM s, t GROUP BY rung, settings""")
def parameter_search(spark, folder):
    """Halving over settings drawn from the whole space of the forest: what each rung tried, and whether its best beats the largest class."""
    prepared, scaled = wsn_rows(spark, folder)
    train = cut_lineage(scaled.part("train"))
    found = search.halving_search(
        "random_forest", search.settings_of("random_forest", SEARCH_DRAWS), train, 2, len(prepared.features), folds=SEARCH_FOLDS, least=SEARCH_LEAST)
    share = F.max("n") / F.sum("n")
    largest = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(2 * share * share / (1 + share)).first()[0]
    rungs = found.table(spark).groupBy("rung").agg(
        F.count(F.lit(1)).cast("int").alias("settings"), F.max("sampled").alias("sampled"), F.bool_and(F.col("f1").between(0, 1)).alias("sound"), F.max("f1").alias("best"))
    return rungs.select("rung", "settings", "sampled", "sound", (F.col("best") > largest).alias("learnt"))


@query("forest_importance")
def forest_importance(spark, folder):
    prepared, scaled = wsn_rows(spark, folder)
    model = classifiers.random_forest().fit(scaled.part("train"))
    return inspect.importance_table(spark, model.featureImportances.toArray(), prepared.features, top=20)


@query("training_history")
def training_history(spark, folder):
    """Loss and accuracy on training and validation rows after each epoch of the dense network."""
    prepared, scaled = wsn_rows(spark, folder)
    model = classifiers.dense_network(len(prepared.features), 2, "vgg16", validation="held").fit(with_held_rows(scaled))
    return rounded(inspect.history_table(spark, model.history), ["loss", "accuracy", "val_loss", "val_accuracy"])


@query("recursive_elimination")
def recursive_elimination(spark, folder):
    prepared, scaled = wsn_rows(spark, folder)
    data = scaled.part("train").select("label", *[F.get(vector_to_array("features"), i).alias(c) for i, c in enumerate(prepared.features)])
    kept = select.fit_selection(data, prepared.features, "label", "rfe", 12, trees=5, maxDepth=4).selected
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("model_based_selection")
def model_based_selection(spark, folder):
    prepared, scaled = wsn_rows(spark, folder)
    data = scaled.part("train").select("label", *[F.get(vector_to_array("features"), i).alias(c) for i, c in enumerate(prepared.features)])
    chosen = select.fit_selection(data, prepared.features, "label", "model_based", 8, trees=10, maxDepth=5)
    return inspect.importance_table(spark, [s for _, s in chosen.scores], [c for c, _ in chosen.scores], top=8)


@query("pca", """
    WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem),
    c AS (SELECT covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_extendedprice, l_extendedprice) AS yy FROM lineitem),
    e AS (SELECT (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS ev, * FROM c),
    v AS (SELECT xy / sqrt(xy * xy + pow(ev - xx, 2)) * sign(ev - xx) AS vx, abs(ev - xx) / sqrt(xy * xy + pow(ev - xx, 2)) AS vy FROM e)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - a) * vx + (l_extendedprice - b) * vy, 2) AS pc0 FROM lineitem, m, v""")
def pca(spark, folder):
    """First principal component of two centred columns (closed form in the SQL twin)."""
    df = table(spark, folder, "lineitem")
    columns = ["l_quantity", "l_extendedprice"]
    model = select.fit_pca(df, columns, 1)
    return rounded(model.transform(df).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "pc0"), ["pc0"], 2)


# --- whole runs --------------------------------------------------------------

def _run(prepared, average="weighted", save_to=None):
    """All eight models at their documented settings; an error in one is an error of the run."""
    models = classifiers.standard_models(prepared.classes, len(prepared.features))
    trained = experiments.run(prepared, models, average, save_to)[0]
    if trained.errors:
        raise RuntimeError(str(trained.errors))
    return trained


def cicids_experiment(spark, folder, binary=True):
    return _run(experiments.prepare_cicids(spark, cleaning.write_cicids(spark, folder), cleaning.CICIDS_TYPES, "double", binary))


def nsl_experiment(spark, folder, binary=True):
    return _run(experiments.prepare_nsl_kdd(spark, *cleaning.write_nsl_kdd(spark, folder), binary))


def wsn_experiment(spark, folder, binary=True):
    return _run(experiments.prepare_wsn(spark, cleaning.write_wsn(spark, folder), cleaning.wsn_schema(), binary), "macro")


def cyber_experiment(spark, folder, binary=True):
    """The eight models, and boosting on raw categories."""
    prepared = experiments.prepare_cyber(spark, cleaning.write_cyber(spark, folder), cleaning.CYBER_SCHEMA, binary)
    trained = _run(prepared, "macro")
    started = time.time()
    model, scored = experiments.boost_raw_categories(prepared, patience=PATIENCE)
    trained.add(prepared.dataset, "Category Boosting", model, scored, "macro", time.time() - started)
    return trained


def _timeless(df):
    return rounded(df.drop("train_seconds"), ["accuracy", "precision", "recall", "f1", "roc_auc"])


#: Whole runs by name: attack categories where the files have them, else attack or not.
RUNS = {
    "cicids": lambda spark, folder: cicids_experiment(spark, folder, binary=False), "nsl": nsl_experiment, "wsn": wsn_experiment,
    "cyber": lambda spark, folder: cyber_experiment(spark, folder, binary=False),
}


@functools.lru_cache(maxsize=8)
def _run_rows(application: str, folder: str, name: str) -> tuple:
    """The rows of a whole run; one that was made in this session already is not fitted again."""
    return tuple(RUNS[name](SparkSession.getActiveSession(), folder).rows)


def _finished(spark, folder, name):
    return training.Trained(list(_run_rows(spark.sparkContext.applicationId, folder, name)))


@query("cicids_run")
def cicids_run(spark, folder):
    return _timeless(_finished(spark, folder, "cicids").results(spark))


@query("nsl_kdd_run")
def nsl_kdd_run(spark, folder):
    return _timeless(_finished(spark, folder, "nsl").results(spark))


@query("wsn_run")
def wsn_run(spark, folder):
    return _timeless(_finished(spark, folder, "wsn").results(spark))


@query("cyber_run")
def cyber_run(spark, folder):
    return _timeless(_finished(spark, folder, "cyber").results(spark))


@query("all_datasets_run")
def all_datasets_run(spark, folder):
    """All four runs, combined, written as a results file, and held against the published scores."""
    done, failed = experiments.run_all({n: (lambda n=n: _finished(spark, folder, n)) for n in RUNS})
    if failed:
        raise RuntimeError(str(failed))
    combined = experiments.combined_results(spark, done)
    path = save_results(combined, scratch_path(spark, "results"))
    stored = spark.read.option("header", True).schema(training.RESULT_SCHEMA).csv(path)
    return rounded(published_gap(stored), ["best_f1", "gap"])


@query("saved_model_scores", f"SELECT target::int AS label, count(*) AS scored, true AS equal_answers FROM ({_WSN_BINARY}) GROUP BY target")
def saved_model_scores(spark, folder):
    """Scaler and classifier saved together and loaded again give unscaled rows the answers of the fitted model."""
    prepared, scaled = wsn_rows(spark, folder)
    fitted = classifiers.decision_tree().fit(scaled.part("train"))
    again = load_model(save_model(scaled.scorer(fitted), scratch_path(spark, "model")))
    raw = prepared.data.select("key", F.col("target").cast("double").alias("label"), F.lit("new").alias("split"),
                               *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(prepared.features)])
    first = fitted.transform(scaled.rows).select("key", F.col("prediction").alias("first"))
    both = again.transform(raw).join(first, "key")
    return both.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("scored"), F.bool_and(F.col("prediction") == F.col("first")).alias("equal_answers"))


def _one_of_each_kind(classes, inputs):
    """An estimator of every kind that can be saved; what is tested is the way to disk and back, so they are small."""
    members = {"tree": classifiers.decision_tree(4), "bayes": classifiers.naive_bayes()}
    return {
        "spark": classifiers.decision_tree(5), "extra trees": classifiers.extra_trees(3, 4), "neighbours": classifiers.NearestNeighbors("key", 5),
        "kernel": KernelClassifier(32, iterations=10), "boosting": classifiers.boosted_trees(classes, 3, 3), "dense": classifiers.DenseNetwork([inputs, 16, classes], 1),
        "voting": ensembles.VotingEnsemble(members, classes=classes),
    }


@query("saved_model_kinds", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, target::int AS label, count(*) AS scored, true AS equal_answers FROM ({split_sql(_WSN_BINARY, 'id', 'target')}) WHERE split = 'test' GROUP BY target"
    for kind in ("boosting", "dense", "extra trees", "kernel", "neighbours", "spark", "stacking", "voting")))
def saved_model_kinds(spark, folder):
    """A model of every kind, saved behind its scaler and loaded again, gives unscaled test rows the answers of the fitted one."""
    prepared, scaled = wsn_rows(spark, folder)
    train = cut_lineage(splits.folds(scaled.part("train"), "key", "label", 3))
    raw = prepared.data.select("key", F.col("target").cast("double").alias("label"), F.lit("new").alias("split"),
                               *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(prepared.features)])
    test = cut_lineage(scaled.part("test"))
    raw = cut_lineage(raw.join(test.select("key"), "key"))
    kinds = _one_of_each_kind(2, len(prepared.features))
    kinds["stacking"] = ensembles.StackingEnsemble({"tree": kinds["spark"], "bayes": classifiers.naive_bayes()}, "fold", 3, iterations=20)
    out = None
    for kind, estimator in kinds.items():
        fitted = estimator.fit(train)
        again = Scorer.load(spark, scaled.any_scorer(fitted).save(spark, scratch_path(spark, "scorer")))
        first = fitted.transform(test).select("key", F.col("prediction").alias("first"))
        both = again.transform(raw).join(first, "key").groupBy(F.col("label").cast("int").alias("label")).agg(
            F.count(F.lit(1)).alias("scored"), F.bool_and(F.col("prediction") == F.col("first")).alias("equal_answers"))
        both = both.withColumn("kind", F.lit(kind))
        out = both if out is None else out.unionByName(both)
    return out


@query("line_tree", tested_sql(split_sql(
    "SELECT row_number() OVER () AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS target FROM lineitem", "id", "target", val=0.0), learnt=False))
def line_tree(spark, folder):
    """Three classes of the largest table; how many rows of a class are tested does not depend on the keys."""
    rows = lines(spark, folder)
    model = classifiers.decision_tree(10).fit(rows.where("split = 'train'"))
    return tested(model.transform(rows.where("split = 'test'")), 3, learnt=False)
