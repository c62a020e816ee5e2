"""Classification and detection metrics, all derived from one count per (truth, prediction).

``by`` names grouping columns such as the model, so any number of models is
evaluated in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where that is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by, F.col(truth).cast("int").alias("y_true"), F.col(prediction).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def normalised_confusion(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Share of each prediction within its true class; null for a class that never occurs."""
    totals = Window.partitionBy(*by, "y_true")
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(totals).cast("double")))


def class_scores(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Support, predicted count, precision, recall and F1 per class found in either column."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    per_class = (
        counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    return per_class.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")),
        "recall": _ratio(F.col("tp"), F.col("support")),
        "f1": _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
    })


def summary_scores(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Accuracy, weighted and macro precision/recall/F1, Cohen's kappa, Matthews correlation."""
    per_class = class_scores(counts, by)
    weight = F.col("support").cast("double")
    s, p = F.col("support").cast("double"), F.col("predicted").cast("double")
    sums = per_class.groupBy(*by).agg(
        F.sum(s).alias("total"),
        F.sum("tp").cast("double").alias("correct"),
        F.sum(s * p).alias("sp"), F.sum(s * s).alias("ss"), F.sum(p * p).alias("pp"),
        *[F.sum(weight * F.col(m)).alias(f"{m}_sum") for m in ("precision", "recall", "f1")],
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
    )
    n = F.col("total")
    by_chance = F.col("sp") / (n * n)
    agreement = F.col("correct") / n
    spread = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("ss")))
    return sums.select(
        *by,
        agreement.alias("accuracy"),
        *[_ratio(F.col(f"{m}_sum"), n).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
        *[F.col(f"{m}_macro") for m in ("precision", "recall", "f1")],
        F.try_divide(agreement - by_chance, 1 - by_chance).alias("cohen_kappa"),
        _ratio(F.col("correct") * n - F.col("sp"), spread).alias("mcc"),
    )


def class_report(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    The accuracy row repeats the accuracy in every column, support included.
    """
    per_class = class_scores(counts)
    text = F.col("cls").cast("string")
    if names:
        text = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.col("cls")), text)
    measures = ("precision", "recall", "f1")
    rows = per_class.select(text.alias("class"), *measures, F.col("support").cast("double").alias("support"))
    total = F.sum("support").cast("double")
    averages = per_class.agg(
        (F.sum("tp") / total).alias("accuracy"),
        total.alias("support"),
        *[F.avg(m).alias(f"{m}_macro") for m in measures],
        *[(F.sum(F.col("support") * F.col(m)) / total).alias(f"{m}_weighted") for m in measures],
    )

    def line(name: str, cells: list[Column], support: Column) -> Column:
        named = [c.alias(m) for c, m in zip(cells, measures)]
        return F.struct(F.lit(name).alias("class"), *named, support.alias("support"))

    accuracy = F.col("accuracy")
    summary = averages.select(F.explode(F.array(
        line("accuracy", [accuracy] * 3, accuracy),
        line("macro avg", [F.col(f"{m}_macro") for m in measures], F.col("support")),
        line("weighted avg", [F.col(f"{m}_weighted") for m in measures], F.col("support")),
    )).alias("r")).select("r.*")
    return rows.unionByName(summary)


def detection_scores(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Binary view: the smallest class is normal, all others together are attacks."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    normal = F.min(F.least("y_true", "y_pred")).over(group)  # a few counts per group
    marked = counts.withColumn("__t", F.col("y_true") != normal).withColumn("__p", F.col("y_pred") != normal)
    t, p, n = F.col("__t"), F.col("__p"), F.col("n")

    def cell(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    cells = marked.groupBy(*by).agg(
        cell(t & p).alias("true_positives"),
        cell(~t & ~p).alias("true_negatives"),
        cell(~t & p).alias("false_positives"),
        cell(t & ~p).alias("false_negatives"),
    )
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    return cells.withColumns({
        "detection_rate": _ratio(tp, tp + fn),
        "false_alarm_rate": _ratio(fp, fp + tn),
        "precision": _ratio(tp, tp + fp),
        "specificity": _ratio(tn, tn + fp),
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
    })
