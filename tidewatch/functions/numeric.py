"""Number repair and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
# Fixed value: what is added to a denominator before dividing.
EPSILON = 1e-8


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text to double; whatever does not parse becomes null (ANSI ``cast`` would raise)."""
    return as_column(c).try_cast("double")


def is_infinite(c: Column | str) -> Column:
    return F.abs(as_column(c)) == F.lit(INFINITY)


def nan_to_null(c: Column | str) -> Column:
    col = as_column(c)
    return F.when(~F.isnan(col), col)


def finite_sql(expression: str) -> str:
    """The value of a numeric expression, null when it is NaN or infinite (NaN is above every number)."""
    return f"CASE WHEN abs({expression}) < double('Infinity') THEN {expression} END"


def nonfinite_to_null(name: str) -> Column:
    """NaN and both infinities become null.

    Has to come before any statistic: Spark sorts NaN above every number and
    lets it swallow averages.
    """
    return F.expr(finite_sql(quoted(name)))


def finite_double(name: str) -> Column:
    """A numeric column as double, with null for whatever is not finite."""
    return F.expr(finite_sql(f"double({quoted(name)})"))


def nonfinite_to_zero(name: str) -> Column:
    return F.expr(f"coalesce({finite_sql(f'double({quoted(name)})')}, 0D)")


def shifted_ratio(a: Column | str, b: Column | str, epsilon: float = EPSILON) -> Column:
    """``a / (b + epsilon)``; null where the shifted denominator is zero."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double") + F.lit(epsilon))


def flag(condition: Column) -> Column:
    """A condition as 0/1, with null counting as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def sql_double(value: float) -> str:
    """A double literal for generated SQL text."""
    value = float(value)
    if value != value:
        return "double('NaN')"
    if value in (INFINITY, -INFINITY):
        return f"double('{'-' if value < 0 else ''}Infinity')"
    return f"{value!r}D"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
