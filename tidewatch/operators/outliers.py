"""Clipping bounds and outlier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.functions.numeric import quoted, sql_double
from tidewatch.operators.encode import column_statistics
from tidewatch.operators.fitted import FittedColumns
from tidewatch.operators.quantiles import exact_quantiles


def iqr_bounds(df: DataFrame, columns: list[str], threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    found = exact_quantiles(df, columns, [0.25, 0.75])
    return {
        c: (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        for c, (q1, q3) in found.items() if q1 is not None
    }


def zscore_bounds(df: DataFrame, columns: list[str], threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    stats = column_statistics(df, columns)
    return {
        c: (s["mean"] - threshold * s["std"], s["mean"] + threshold * s["std"])
        for c, s in stats.items() if s["n"]
    }


def fit_clipper(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> FittedColumns:
    """Values outside the bounds move to the nearer bound; missing values stay missing."""
    if method == "isolation_forest":  # declared without bounds: the data passes through
        return FittedColumns({})
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown outlier method: {method}")
    bounds = (iqr_bounds if method == "iqr" else zscore_bounds)(df, columns, threshold)
    return FittedColumns(
        {
            c: f"CASE WHEN {quoted(c)} < {sql_double(lo)} THEN {sql_double(lo)} "
               f"WHEN {quoted(c)} > {sql_double(hi)} THEN {sql_double(hi)} ELSE double({quoted(c)}) END"
            for c, (lo, hi) in bounds.items()
        },
        bounds,
    )
