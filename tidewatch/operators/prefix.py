"""Running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numeric import quoted, sql_double
from tidewatch.session import cut_lineage


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` as a stored table with ``__bucket``: the number of the range of ``order`` that a row fell into.

    The ranges are the partitions of a range shuffle, so their number follows the size of the data and the session, and equal
    values share one.
    """
    return cut_lineage(df.repartitionByRange(*[F.col(quoted(c)) for c in order]).withColumn("__bucket", F.spark_partition_id()))


def bucket_of(column: str, edges: list[float]) -> Column:
    """How many edges lie below the value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {column} <= {sql_double(edges[mid])} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(tree(0, len(edges)))


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str], descending: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """Adds ``<value>_before``: the sum over all rows of the group that come earlier.

    ``order`` must be unique within a group. The rows are cut into value ranges;
    each range is summed by its own task and shifted by the total of the ranges
    before it. With ``ranges``, a table of :func:`in_ranges` that ``df`` stems from, nothing is cut
    again and ``__bucket`` stays.
    """
    bucketed = in_ranges(df, order) if ranges is None else df
    totals = (bucketed if ranges is None else ranges).groupBy(*by, "__bucket").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    bucket_order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    # One row per group and range.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(bucket_order)
    offsets = totals.select(
        *by, "__bucket",
        *[(F.sum(f"__{v}").over(earlier) - F.col(f"__{v}")).alias(f"__{v}_offset") for v in values],
    )
    row_order = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "__bucket").orderBy(row_order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.withColumns({f"__{v}_run": F.sum(v).over(inside) - F.col(v) for v in values})
        .join(offsets, [*by, "__bucket"])
        .withColumns({f"{v}_before": F.col(f"__{v}_run") + F.col(f"__{v}_offset") for v in values})
        .drop(*(["__bucket"] if ranges is None else []), *[f"__{v}_run" for v in values], *[f"__{v}_offset" for v in values])
    )


def numbered(values: DataFrame, by: list[str], order: str, output: str) -> DataFrame:
    """Adds the place of each row in its group, counted from 0; ``order`` must be unique within a group."""
    ranked = running_totals(values.withColumn("__one", F.lit(1).cast("long")), by, order, ["__one"])
    return ranked.withColumnRenamed("__one_before", output).drop("__one")
