"""Queries: confusion counts, scores, curves, model and dataset comparison, ensembles of given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.models import ensembles
from tidewatch.operators import compare, curves, metrics
from tidewatch.plans.derived import ALL_SCORES_SQL, CLASSES, MODELS, all_scores, scores, scores_sql
from tidewatch.plans.registry import query, rounded, table

P = [f"p{c}" for c in range(len(CLASSES))]
S = scores_sql()
SCORES = ["precision", "recall", "f1"]


@query("confusion", f"SELECT y::int AS y_true, pred::int AS y_pred, count(*) AS n FROM ({S}) GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(scores(spark, folder), "y", "pred")


@query("confusion_share", f"""
    SELECT y::int AS y_true, pred::int AS y_pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share
    FROM ({S}) GROUP BY y, pred""")
def confusion_share(spark, folder):
    return rounded(metrics.normalised_confusion(metrics.confusion(scores(spark, folder), "y", "pred")), ["share"])


def class_sql(source: str, by: str = "") -> str:
    """Per-class counts and scores restated with a full class list."""
    b, on = (f"{by}, ", f"{by}, cls") if by else ("", "cls")
    return f"""
    SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
           CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1
    FROM (SELECT {b}cls, cast(sum(s) AS double) AS support, cast(sum(p) AS double) AS predicted, cast(sum(t) AS double) AS tp FROM (
        SELECT {b}y AS cls, 1 AS s, 0 AS p, (y = pred)::int AS t FROM ({source}) UNION ALL
        SELECT {b}pred, 0, 1, 0 FROM ({source})) GROUP BY {on})"""


def summary_sql(source: str, by: str = "") -> str:
    b, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
    SELECT {b}round(sum(tp) / sum(support), 6) AS accuracy,
           round(sum(support * precision) / sum(support), 6) AS precision_weighted, round(sum(support * recall) / sum(support), 6) AS recall_weighted,
           round(sum(support * f1) / sum(support), 6) AS f1_weighted, round(avg(precision), 6) AS precision_macro,
           round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
           round((sum(tp) / sum(support) - sum(support * predicted) / pow(sum(support), 2)) / (1 - sum(support * predicted) / pow(sum(support), 2)), 6) AS cohen_kappa,
           round((sum(tp) * sum(support) - sum(support * predicted)) / sqrt((pow(sum(support), 2) - sum(predicted * predicted)) * (pow(sum(support), 2) - sum(support * support))), 6) AS mcc
    FROM ({class_sql(source, by)}) {group}"""


SUMMARY = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "precision_macro", "recall_macro", "f1_macro",
           "cohen_kappa", "mcc"]


@query("class_scores", f"SELECT cls::int AS cls, support::bigint AS support, predicted::bigint AS predicted, tp::bigint AS tp, "
                       f"round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({class_sql(S)})")
def class_scores(spark, folder):
    return rounded(metrics.class_scores(metrics.confusion(scores(spark, folder), "y", "pred")), SCORES)


@query("summary_scores", summary_sql(S))
def summary_scores(spark, folder):
    """Accuracy, weighted and macro scores, kappa and Matthews correlation."""
    return rounded(metrics.summary_scores(metrics.confusion(scores(spark, folder), "y", "pred")), SUMMARY)


@query("prf_report", f"""
    WITH c AS ({class_sql(S)})
    SELECT cls::varchar AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c UNION ALL
    SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6) FROM c UNION ALL
    SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM c UNION ALL
    SELECT 'weighted avg', round(sum(support * precision) / sum(support), 6), round(sum(support * recall) / sum(support), 6),
           round(sum(support * f1) / sum(support), 6), sum(support) FROM c""")
def prf_report(spark, folder):
    report = metrics.class_report(metrics.confusion(scores(spark, folder), "y", "pred"))
    return rounded(report, [*SCORES, "support"])


def detection_sql(source: str) -> str:
    return f"""
    SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS detection_rate, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_alarm_rate,
           round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
           round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy
    FROM (SELECT count(*) FILTER (y > 0 AND pred > 0) AS tp, count(*) FILTER (y = 0 AND pred = 0) AS tn,
                 count(*) FILTER (y = 0 AND pred > 0) AS fp, count(*) FILTER (y > 0 AND pred = 0) AS fn FROM ({source}))"""


DETECTION = ["detection_rate", "false_alarm_rate", "precision", "specificity", "accuracy"]


@query("detection_metrics", detection_sql(S))
def detection_metrics(spark, folder):
    return rounded(metrics.detection_scores(metrics.confusion(scores(spark, folder), "y", "pred")), DETECTION)


# --- curves -----------------------------------------------------------------

def auc_sql(source: str, score: str, positive: str, by: str = "") -> str:
    """Mann-Whitney form of the area, ties counting half."""
    b, part, group = (f"{by}, ", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"""
    SELECT {b}sum(pos * (below + neg / 2)) / (sum(pos) * cast(sum(neg) AS double)) AS roc_auc FROM (
        SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
            SELECT {b}{score} AS s, count(*) FILTER ({positive}) AS pos, count(*) FILTER (NOT ({positive})) AS neg FROM ({source}) GROUP BY ALL)) {group}"""


@query("roc_auc", f"SELECT round(roc_auc, 6) AS roc_auc FROM ({auc_sql(S, 'binary_score', 'y > 0')})")
def roc_auc(spark, folder):
    return rounded(curves.auc(scores(spark, folder), "binary_score", F.col("y") > 0), ["roc_auc"])


@query("roc_auc_lines", f"""SELECT round(roc_auc, 6) AS roc_auc FROM (
    {auc_sql("SELECT l_extendedprice * (1 - l_discount) AS sc, l_linestatus FROM lineitem", 'sc', "l_linestatus = 'F'")})""")
def roc_auc_lines(spark, folder):
    """An almost unique score over the largest table."""
    df = table(spark, folder, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sc"), "l_linestatus")
    return rounded(curves.auc(df, "sc", F.col("l_linestatus") == "F"), ["roc_auc"])


def _long(source: str, by: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {by}y, {c} AS c, p{c} AS s FROM ({source})" for c in range(len(CLASSES)))


def ovr_sql(source: str, by: str = "") -> str:
    b, on, group = (f"{by}, ", f"{by}, c", f"GROUP BY {by}") if by else ("", "c", "")
    return f"""
    SELECT {b}sum(roc_auc * n) / sum(n) AS roc_auc_ovr FROM ({auc_sql(_long(source, b), 's', 'y = c', on)})
    JOIN (SELECT {b}y AS c, count(*) AS n FROM ({source}) GROUP BY ALL) USING ({on}) {group}"""


def _pairs(source: str, by: str) -> str:
    n = range(len(CLASSES))
    return " UNION ALL ".join(
        f"SELECT {by}y, {a} AS a, {b} AS b, {side} AS side, p{side} AS s FROM ({source}) WHERE y IN ({a}, {b})"
        for a in n for b in n if a < b for side in (a, b))


def ovo_sql(source: str, by: str = "") -> str:
    b, on, group = (f"{by}, ", f"{by}, a, b", f"GROUP BY {by}") if by else ("", "a, b", "")
    return f"""
    WITH k AS (SELECT {b}y AS cls, count(*) AS n FROM ({source}) GROUP BY ALL),
    d AS (SELECT {on}, avg(roc_auc) AS pair_auc FROM ({auc_sql(_pairs(source, b), 's', 'y = side', on + ', side')}) GROUP BY {on})
    SELECT {b}sum(pair_auc * (ka.n + kb.n)) / sum(ka.n + kb.n) AS roc_auc_ovo
    FROM d JOIN (SELECT {b}cls AS a, n FROM k) ka USING ({b}a) JOIN (SELECT {b}cls AS b, n FROM k) kb USING ({b}b) {group}"""


@query("auc_ovr", f"SELECT round(roc_auc_ovr, 6) AS roc_auc_ovr FROM ({ovr_sql(S)})")
def auc_ovr(spark, folder):
    return rounded(curves.multiclass_auc(scores(spark, folder), "y", P).select("roc_auc_ovr"), ["roc_auc_ovr"])


@query("auc_ovo", f"SELECT round(roc_auc_ovo, 6) AS roc_auc_ovo FROM ({ovo_sql(S)})")
def auc_ovo(spark, folder):
    return rounded(curves.multiclass_auc(scores(spark, folder), "y", P).select("roc_auc_ovo"), ["roc_auc_ovo"])


def curve_sql(source: str, score: str, positive: str, shown: str, by: str = "") -> str:
    b, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""
    SELECT {b}round(s, 9) AS threshold, {shown} FROM (
        SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(neg) OVER ({part} ORDER BY s DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n
        FROM (SELECT {b}{score} AS s, count(*) FILTER ({positive}) AS pos, count(*) FILTER (NOT ({positive})) AS neg FROM ({source}) GROUP BY ALL))"""


@query("roc_points", curve_sql(ALL_SCORES_SQL, "binary_score", "y > 0", "round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr", "model"))
def roc_points(spark, folder):
    """Every point of the ROC curve of three models."""
    points = curves.roc_points(all_scores(spark, folder), "binary_score", F.col("y") > 0, ["model"])
    return rounded(rounded(points, ["fpr", "tpr"]), ["threshold"], 9)


@query("pr_points", curve_sql(S, "binary_score", "y > 0", "round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall"))
def pr_points(spark, folder):
    points = curves.pr_points(scores(spark, folder), "binary_score", F.col("y") > 0)
    return rounded(rounded(points, ["precision", "recall"]), ["threshold"], 9)


@query("roc_points_thinned", curve_sql(S, "binary_score", "y > 0", "round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr") + """
    WHERE floor((tp + fp) * 100 / (p + n)) > floor((tp + fp - pos - neg) * 100 / (p + n)) OR tp + fp = p + n""")
def roc_points_thinned(spark, folder):
    """At most about a hundred points for drawing."""
    points = curves.roc_points(scores(spark, folder), "binary_score", F.col("y") > 0, max_points=100)
    return rounded(rounded(points, ["fpr", "tpr"]), ["threshold"], 9)


# --- comparison -------------------------------------------------------------

COMPARED = f"""
    SELECT s.*, round(r.roc_auc_ovr, 6) AS roc_auc_ovr, round(o.roc_auc_ovo, 6) AS roc_auc_ovo FROM ({summary_sql(ALL_SCORES_SQL, 'model')}) s
    JOIN ({ovr_sql(ALL_SCORES_SQL, 'model')}) r USING (model) JOIN ({ovo_sql(ALL_SCORES_SQL, 'model')}) o USING (model)"""


@query("model_compare", COMPARED)
def model_compare(spark, folder):
    """All metrics of three models in one job."""
    found = compare.compare_models(all_scores(spark, folder), "y", "pred", P)
    return rounded(found, [*SUMMARY, "roc_auc_ovr", "roc_auc_ovo"])


BINARY_MODELS = f"SELECT * REPLACE ((y > 0)::int AS y, (binary_score >= 0.75)::int AS pred) FROM ({ALL_SCORES_SQL})"


@query("model_compare_binary", f"""
    SELECT s.*, round(roc_auc, 6) AS roc_auc FROM ({summary_sql(BINARY_MODELS, 'model')}) s
    JOIN ({auc_sql(BINARY_MODELS, 'binary_score', 'y = 1', 'model')}) USING (model)""")
def model_compare_binary(spark, folder):
    df = all_scores(spark, folder).withColumns({
        "y": (F.col("y") > 0).cast("int"), "pred": (F.col("binary_score") >= 0.75).cast("int"), "other": 1 - F.col("binary_score"),
    })
    return rounded(compare.compare_models(df, "y", "pred", ["other", "binary_score"]), [*SUMMARY, "roc_auc"])


def _summary(spark, folder):
    counts = metrics.confusion(all_scores(spark, folder), "y", "pred", ["model"])
    return rounded(metrics.summary_scores(counts, ["model"]), SUMMARY)


@query("model_ranking", f"SELECT model, f1_weighted FROM ({summary_sql(ALL_SCORES_SQL, 'model')})")
def model_ranking(spark, folder):
    return compare.ranking(_summary(spark, folder), "f1_weighted")


@query("metric_table", f"""
    SELECT model, metric, value FROM ({summary_sql(ALL_SCORES_SQL, 'model')})
    UNPIVOT (value FOR metric IN (accuracy, precision_weighted, recall_weighted, f1_weighted))""")
def metric_table(spark, folder):
    """Metric by model in long form, as a grouped bar chart needs it."""
    return compare.long_metrics(_summary(spark, folder), ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "absent"])


_ORDINAL = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS)) + " END"


@query("best_model", f"""
    SELECT model AS best_model FROM (SELECT *, {_ORDINAL} AS o FROM ({summary_sql(ALL_SCORES_SQL, 'model')})) ORDER BY f1_weighted DESC, o LIMIT 1""")
def best_model(spark, folder):
    return compare.best_model(_summary(spark, folder).withColumn("ordinal", F.expr(_ORDINAL)), "f1_weighted", "ordinal")


@query("best_model_without_metric", f"""
    SELECT model AS best_model FROM (SELECT *, {_ORDINAL} AS o FROM ({summary_sql(ALL_SCORES_SQL, 'model')})) ORDER BY o LIMIT 1""")
def best_model_without_metric(spark, folder):
    """An unknown metric falls back to the first model."""
    return compare.best_model(_summary(spark, folder).withColumn("ordinal", F.expr(_ORDINAL)), "no_such_metric", "ordinal")


# Three datasets are three thirds of the events; each model is scored on each.
DATASETS = ["CICIDS2017", "NSL-KDD", "WSN-DS"]
_DATASET = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DATASETS)) + " END"
RESULTS_SQL = f"""
    SELECT split_part(run, '/', 1) AS dataset, split_part(run, '/', 2) AS model, accuracy, f1_weighted AS f1 FROM (
        {summary_sql(f"SELECT *, {_DATASET} || '/' || model AS run FROM ({ALL_SCORES_SQL})", 'run')})"""


def _results(spark, folder):
    df = all_scores(spark, folder).withColumn("dataset", F.expr(_DATASET))
    found = metrics.summary_scores(metrics.confusion(df, "y", "pred", ["dataset", "model"]), ["dataset", "model"])
    kept = found.select("dataset", "model", "accuracy", F.col("f1_weighted").alias("f1"), F.expr(_ORDINAL).alias("ordinal"))
    return rounded(kept, ["accuracy", "f1"])


@query("published_gap", f"""
    SELECT dataset, best_model, best_f1, CASE WHEN dataset IN ('CICIDS2017', 'NSL-KDD') THEN 'Extra Trees' ELSE 'Unknown' END AS published_model,
           cast(CASE dataset WHEN 'CICIDS2017' THEN 0.998 WHEN 'NSL-KDD' THEN 0.995 ELSE 0.99 END AS double) AS published_f1,
           round(best_f1 - cast(CASE dataset WHEN 'CICIDS2017' THEN 0.998 WHEN 'NSL-KDD' THEN 0.995 ELSE 0.99 END AS double), 6) AS gap,
           best_f1 - CASE dataset WHEN 'CICIDS2017' THEN 0.998 WHEN 'NSL-KDD' THEN 0.995 ELSE 0.99 END >= 0 AS beats_published
    FROM (SELECT dataset, arg_max(model, f1) AS best_model, max(f1) AS best_f1 FROM ({RESULTS_SQL}) GROUP BY dataset)""")
def published_gap(spark, folder):
    return rounded(compare.published_gap(_results(spark, folder)), ["gap"])


@query("dataset_results", f"SELECT * FROM ({RESULTS_SQL}) WHERE dataset = 'NSL-KDD'")
def dataset_results(spark, folder):
    return compare.results_of(_results(spark, folder), "NSL-KDD").drop("ordinal")


@query("best_per_dataset", f"SELECT dataset, arg_max(model, f1) AS model, max(f1) AS f1 FROM ({RESULTS_SQL}) GROUP BY dataset")
def best_per_dataset(spark, folder):
    return compare.best_per_dataset(_results(spark, folder))


# --- ensembles of given scores ----------------------------------------------

WIDE_SQL = "SELECT w.event_id, w.y, " + ", ".join(
    f"{a}.p{c} AS {m}_{c}" for m, a in (("weak", "w"), ("medium", "m"), ("strong", "s")) for c in range(len(CLASSES))
) + ", w.pred AS weak_pred, m.pred AS medium_pred, s.pred AS strong_pred " + \
    f"FROM ({scores_sql('weak')}) w JOIN ({scores_sql('medium')}) m USING (event_id) JOIN ({scores_sql('strong')}) s USING (event_id)"


def wide_scores(spark, folder):
    """The class scores of three models side by side in the same row."""
    from tidewatch.plans import derived

    columns = {"event_id": "event_id", "y": derived.SCORES["weak"]["y"]}
    for m in MODELS:
        parts = ", ".join(derived.SCORES[m][p] for p in P)
        columns[m] = f"array({parts})"
        columns[f"{m}_pred"] = derived.SCORES[m]["pred"]
    return derived.spark_from_events(spark, folder, columns)


def vote_sql(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    mean = [" + ".join(f"{m}_{c} * {w / total!r}::double" for m, w in weights.items()) for c in range(len(CLASSES))]
    best = "greatest(" + ", ".join(mean) + ")"
    choice = "CASE " + " ".join(f"WHEN {x} = {best} THEN {c}" for c, x in enumerate(mean)) + " END"
    return f"SELECT event_id, {choice} AS prediction, round({mean[0]}, 6) AS first_class FROM ({WIDE_SQL})"


@query("soft_vote", vote_sql({"weak": 1, "medium": 1, "strong": 1}))
def soft_vote(spark, folder):
    voted = ensembles.soft_vote(wide_scores(spark, folder), list(MODELS))
    return voted.select("event_id", F.col("prediction"), F.round(F.get("probability", 0), 6).alias("first_class"))


@query("weighted_average", vote_sql({"weak": 1, "medium": 2, "strong": 5}))
def weighted_average(spark, folder):
    """Weights 1, 2 and 5, normalised to sum to one."""
    voted = ensembles.soft_vote(wide_scores(spark, folder), list(MODELS), [1, 2, 5])
    return voted.select("event_id", F.col("prediction"), F.round(F.get("probability", 0), 6).alias("first_class"))


@query("hard_vote", f"""
    WITH v AS (SELECT event_id, unnest([weak_pred, medium_pred, strong_pred]) AS c FROM ({WIDE_SQL})),
    n AS (SELECT event_id, c, count(*) AS n FROM v GROUP BY ALL)
    SELECT event_id, c::int AS prediction FROM n QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, c) = 1""")
def hard_vote(spark, folder):
    """Majority of predictions, the lowest class on ties."""
    voted = ensembles.hard_vote(wide_scores(spark, folder), [f"{m}_pred" for m in MODELS], len(CLASSES))
    return voted.select("event_id", "prediction")


_WEIGHTS = ensembles.random_weights(3, 12, seed=7)
_WEIGHT_ROWS = ", ".join(f"({i}, {', '.join(f'{w!r}::double' for w in ws)})" for i, ws in enumerate(_WEIGHTS))


@query("weight_search", f"""
    WITH t(trial, w0, w1, w2) AS (VALUES {_WEIGHT_ROWS}),
    s AS (SELECT trial, y, {", ".join(f"weak_{c} * w0 + medium_{c} * w1 + strong_{c} * w2 AS q{c}" for c in range(len(CLASSES)))} FROM ({WIDE_SQL}), t),
    p AS (SELECT trial, y, CASE {" ".join(f"WHEN q{c} = greatest(q0, q1, q2, q3, q4) THEN {c}" for c in range(len(CLASSES)))} END AS pred FROM s)
    SELECT trial::int AS trial, f1_weighted FROM ({summary_sql('SELECT * FROM p', 'trial')})""")
def weight_search(spark, folder):
    """Weighted F1 of random weightings, from one pass over the scores."""
    found = ensembles.score_weights(wide_scores(spark, folder), "y", list(MODELS), _WEIGHTS)
    return rounded(found.select("trial", "f1_weighted"), ["f1_weighted"])
