"""Missing and infinite values, duplicates, constant columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import (
    finite_double, is_infinite, nan_to_null, nonfinite_to_null, nonfinite_to_zero, quoted, sql_double, to_number,
)
from tidewatch.operators.fitted import FittedColumns
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.sources.columns import fractional_columns, numeric_columns, string_columns


def mark_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of every fractional column become null."""
    return df.withColumns({c: nonfinite_to_null(c) for c in fractional_columns(df)})


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without any value."""
    found = exact_quantiles(df, columns, [0.5])
    return {c: 0.0 if found[c][0] is None else found[c][0] for c in columns}


def fit_median_imputer(df: DataFrame, columns: list[str] | None = None) -> FittedColumns:
    """Missing and infinite numbers take the median of the finite ones."""
    columns = numeric_columns(df) if columns is None else columns
    middle = medians(df.select(*[finite_double(c).alias(c) for c in columns]), columns)
    return FittedColumns(
        {c: f"CASE WHEN abs(double({quoted(c)})) < double('Infinity') THEN double({quoted(c)}) "
            f"ELSE {sql_double(m)} END" for c, m in middle.items()},
        middle,
    )


def impute_median(df: DataFrame, columns: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    return fit_median_imputer(df if fit_on is None else fit_on, columns).transform(df)


def fit_coercing_imputer(df: DataFrame, columns: list[str]) -> FittedColumns:
    """Text is parsed to numbers first; infinities take part in the median and are replaced afterwards."""
    middle = medians(df.select(*[to_number(quoted(c)).alias(c) for c in columns]), columns)
    return FittedColumns(
        {c: f"CASE WHEN abs(try_cast({quoted(c)} AS DOUBLE)) < double('Infinity') "
            f"THEN try_cast({quoted(c)} AS DOUBLE) ELSE {sql_double(m)} END" for c, m in middle.items()},
        middle,
    )


def fill_unknown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.fill("Unknown", subset=string_columns(df) if columns is None else columns)


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Last sweep before a matrix is built: nothing missing or infinite is left."""
    return df.withColumns({c: nonfinite_to_zero(c) for c in columns})


def _is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(quoted(name))
    return (col.isNull() | F.isnan(col)) if name in fractional_columns(df) else col.isNull()


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: how many cells of the table are missing."""
    return df.agg(sum((F.count_if(_is_missing(df, c)) for c in df.columns), F.lit(0)).alias("missing_cells"))


def missing_per_column(df: DataFrame) -> DataFrame:
    """(column, missing), from a single aggregation."""
    counted = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns])
    return counted.unpivot([], [F.col(quoted(c)) for c in df.columns], "column_name", "missing")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of each set of copies.

    The shuffle is preceded by a partial aggregation, so a hot set of copies
    reaches its reducer as one row per map task.
    """
    return df.dropDuplicates()


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: rows before, rows after dropping copies, rows removed."""
    copies = df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("rows_removed"),
    )


def constant_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_constant): at most one distinct value, found by comparing minimum and maximum."""
    values = df.select(*[
        (nan_to_null(c) if c in fractional_columns(df) else F.col(quoted(c))).alias(c) for c in columns
    ])
    checks = values.agg(*[
        F.min(quoted(c)).eqNullSafe(F.max(quoted(c))).alias(c) for c in columns
    ])
    return checks.unpivot([], [F.col(quoted(c)) for c in columns], "column_name", "is_constant")


def drop_constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return df
    flat = [r.column_name for r in constant_flags(df, columns).where("is_constant").collect()]
    return df.drop(*flat)
