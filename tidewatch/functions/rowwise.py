"""New features computed within one row, as generated expressions over named columns.

Every function returns ``{new column: expression}``; the names follow the
position of the inputs, so ``x0_times_x1`` belongs to the first two columns.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, islice

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.numeric import shifted_ratio


def _doubles(columns: list[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


def interaction_features(
    columns: list[str],
    pairs: list[tuple[int, int]] | None = None,
    max_features: int = 10,
) -> dict[str, Column]:
    """Product and ratio of the first ``max_features`` pairs, ordered by position."""
    if pairs is None:
        pairs = combinations(range(min(max_features, len(columns))), 2)
    x = _doubles(columns)
    out: dict[str, Column] = {}
    for i, j in islice(pairs, max_features):
        if i < len(x) and j < len(x):
            out[f"x{i}_times_x{j}"] = x[i] * x[j]
            out[f"x{i}_over_x{j}"] = shifted_ratio(x[i], x[j])
    return out


def row_statistics(columns: list[str]) -> dict[str, Column]:
    """Mean, population deviation, minimum, maximum and median across the columns."""
    x = _doubles(columns)
    n = len(x)

    def add(terms):
        return reduce(lambda a, b: a + b, terms)

    mean = add(x) / F.lit(float(n))
    spread = F.sqrt(add([(c - mean) * (c - mean) for c in x]) / F.lit(float(n)))
    ordered = F.sort_array(F.array(*x))
    middle = [F.get(ordered, (n - 1) // 2), F.get(ordered, n // 2)]
    return {
        "row_mean": mean,
        "row_std": spread,
        "row_min": F.array_min(F.array(*x)),
        "row_max": F.array_max(F.array(*x)),
        "row_median": (middle[0] + middle[1]) / F.lit(2.0),
    }


def ratio_features(columns: list[str], pairs: list[tuple[int, int]]) -> dict[str, Column]:
    x = _doubles(columns)
    return {
        f"ratio_{i}_{j}": shifted_ratio(x[i], x[j])
        for i, j in pairs
        if i < len(x) and j < len(x)
    }


def power_features(
    columns: list[str], degree: int = 2, selected: list[int] | None = None
) -> dict[str, Column]:
    """Powers 2..degree of the chosen columns (the first ten by default), without cross terms."""
    x = _doubles(columns)
    chosen = range(min(10, len(x))) if selected is None else selected
    return {
        f"x{i}_pow{d}": F.pow(x[i], F.lit(float(d)))
        for i in chosen
        if i < len(x)
        for d in range(2, degree + 1)
    }
