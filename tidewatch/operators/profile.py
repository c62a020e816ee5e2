"""Descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import as_column, finite_double, quoted


def class_distribution(df: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """Rows per label, most frequent first, ties by label."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
    return counted.limit(top) if top else counted


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def dataset_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows, feature count (label and difficulty are no features) and number of classes."""
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(df.columns) - 2).alias("n_features"),
        F.count_distinct(label).alias("n_classes"),
    )


def full_profile(df: DataFrame, label: str) -> DataFrame:
    """(item, name, n): samples, features and classes as :func:`dataset_profile` counts them, the columns of each type, and the rows of each class, null as its own.

    One pass over the label column; the rest comes from its counts and the schema.
    """
    spark = df.sparkSession
    classes = df.groupBy(F.col(label).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    classes = classes.select(F.lit("class").alias("item"), "name", "n")
    totals = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.count("name").alias("classes"))
    totals = totals.unpivot([], ["samples", "classes"], "item", "n").select("item", F.lit(None).cast("string").alias("name"), "n")
    kinds: dict[str, int] = {}
    for field in df.schema.fields:
        kinds[field.dataType.simpleString()] = kinds.get(field.dataType.simpleString(), 0) + 1
    fixed = [("features", None, len(df.columns) - 2), *(("type", kind, n) for kind, n in sorted(kinds.items()))]
    return totals.unionByName(spark.createDataFrame(fixed, "item string, name string, n long")).unionByName(classes)


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(quoted(c)).alias(c) for c in columns])
    return row.unpivot([], [F.col(quoted(c)) for c in columns], "column_name", "n_distinct")


def class_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(finite_double(c)).alias(f"mean_{c}") for c in columns])


def class_shares(df: DataFrame, label: str, category: Column | str) -> DataFrame:
    """Share of each category within its class."""
    counted = df.groupBy(F.col(label), as_column(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(label).agg(F.sum("n").alias("class_total"))
    return counted.join(totals, label).select(label, "category", "n", (F.col("n") / F.col("class_total")).alias("share"))
