"""Fitted row-wise steps, held as SQL expressions.

A step that was fitted on one table (scaler, imputer, clipper, encoder) is no
more than a set of expressions with the fitted numbers written into them. It can
be applied to any batch or stream, and saved as a stage of a ``PipelineModel``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import quoted


@dataclass
class FittedColumns:
    """Output column -> SQL expression, plus whatever statistics led to it."""

    expressions: dict[str, str]
    statistics: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in self.expressions.items()})

    def stage(self, columns: list[str]) -> SQLTransformer:
        """The same step as a saveable stage for a table with these columns."""
        kept = [quoted(c) for c in columns if c not in self.expressions]
        made = [f"{e} AS {quoted(c)}" for c, e in self.expressions.items()]
        return SQLTransformer(statement=f"SELECT {', '.join(kept + made)} FROM __THIS__")
