"""Exact quantiles (linear interpolation) of many columns in a few passes."""

from __future__ import annotations

import math
import struct
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import quoted, sql_double

# An exact counter (one entry per distinct value) only ever sees this many values.
COUNTED_VALUES = 100_000
# Accuracy of the sketch that brackets a rank, and how far it may be raised.
SKETCH_ACCURACY = 10_000
FINEST_ACCURACY = 1_000_000


class Bracket(NamedTuple):
    """Values in [lo, hi] hold the wanted rank; ``below`` of the others are smaller, ``inside`` lie in it."""

    lo: float
    hi: float
    below: int
    inside: int


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    counted_values: int = COUNTED_VALUES,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles per column, equal to sorting each column and interpolating; null and NaN are left out.

    A sketch brackets every wanted rank, one pass counts what lies below and inside
    the brackets, and this repeats until a bracket is a single value or holds few
    enough values to be counted exactly. Where the finest sketch is too coarse, brackets are halved by value.
    """
    if not columns:
        return {}
    numbers = df.selectExpr(*[f"nullif(double({quoted(c)}), double('NaN')) AS v{i}" for i, c in enumerate(columns)])
    names = numbers.columns
    head = numbers.agg(*[F.count(v).alias(v) for v in names]).first()

    # A wanted quantile is a weighted pair of order statistics.
    pairs = {
        v: [(math.floor((head[v] - 1) * p), math.ceil((head[v] - 1) * p), (head[v] - 1) * p) for p in probabilities]
        for v in names if head[v]
    }
    open_ranks = {
        (v, k): Bracket(-math.inf, math.inf, 0, head[v]) for v, ps in pairs.items() for low, high, _ in ps for k in (low, high)
    }
    found: dict[tuple[str, int], float] = {}
    while open_ranks:
        final = {vk: b for vk, b in open_ranks.items() if b.inside <= counted_values}
        found.update(_order_statistics(numbers, final))
        wide = {vk: b for vk, b in open_ranks.items() if vk not in final}
        if accuracy > FINEST_ACCURACY:
            open_ranks = _halve(numbers, wide, found) if wide else {}
            continue
        open_ranks, stuck = _narrow(numbers, wide, accuracy, found) if wide else ({}, False)
        accuracy = accuracy * 10 if stuck else accuracy

    out: dict[str, list[float | None]] = {}
    for c, v in zip(columns, names):
        values = []
        for low, high, at in pairs.get(v, []):
            a, b = found[v, low], found[v, high]
            values.append(a if a == b else (high - at) * a + (at - low) * b)
        out[c] = values or [None] * len(probabilities)
    return out


def _inside(v: str, b: Bracket) -> str:
    if (b.lo, b.hi) == (-math.inf, math.inf):
        return v
    return f"CASE WHEN {v} BETWEEN {sql_double(b.lo)} AND {sql_double(b.hi)} THEN {v} END"


def _shares(ks: list[int], b: Bracket, slack: float = 0.0) -> str:
    """Where the ranks lie inside the bracket; half a rank up, so rounding cannot reach a neighbour."""
    at = [(k - b.below + 0.5) / b.inside + s for k in ks for s in ((-slack, slack) if slack else (0.0,))]
    return "array(" + ", ".join(f"{min(1.0, max(0.0, x))!r}D" for x in at) + ")"


def _by_bracket(brackets: dict) -> list[tuple[str, Bracket, list[int]]]:
    grouped: dict[tuple[str, Bracket], list[int]] = {}
    for (v, k), b in brackets.items():
        grouped.setdefault((v, b), []).append(k)
    return [(v, b, ks) for (v, b), ks in grouped.items()]


def _order_statistics(numbers: DataFrame, brackets: dict) -> dict:
    """The value at each rank, for brackets that hold few values, in one pass."""
    groups = _by_bracket(brackets)
    if not groups:
        return {}
    row = numbers.selectExpr(*[f"{_inside(v, b)} AS b{i}" for i, (v, b, _) in enumerate(groups)]).selectExpr(*[
        f"percentile_disc({_shares(ks, b)}) WITHIN GROUP (ORDER BY b{i}) AS q{i}" for i, (_, b, ks) in enumerate(groups)
    ]).first()
    return {(v, k): row[f"q{i}"][j] for i, (v, _, ks) in enumerate(groups) for j, k in enumerate(ks)}


def _narrow(numbers: DataFrame, brackets: dict, accuracy: int, found: dict) -> tuple[dict, bool]:
    """Shrink each bracket around its rank; returns the open ones and whether one did not shrink."""
    groups = _by_bracket(brackets)
    edges = numbers.selectExpr(*[f"{_inside(v, b)} AS b{i}" for i, (v, b, _) in enumerate(groups)]).selectExpr(*[
        f"percentile_approx(b{i}, {_shares(ks, b, 2.0 / accuracy)}, {accuracy}) AS e{i}" for i, (_, b, ks) in enumerate(groups)
    ]).first()
    tighter = {
        (v, k): (edges[f"e{i}"][2 * j], edges[f"e{i}"][2 * j + 1]) for i, (v, _, ks) in enumerate(groups) for j, k in enumerate(ks)
    }
    spans = sorted({(v, *span) for (v, _), span in tighter.items()})
    row = numbers.selectExpr(*[
        f"{what} AS {name}{i}" for i, (v, lo, hi) in enumerate(spans) for name, what in (
            ("below", f"count_if({v} < {sql_double(lo)})"),
            ("inside", f"count_if({v} BETWEEN {sql_double(lo)} AND {sql_double(hi)})"),
        )
    ]).first()
    counted = {span: (row[f"below{i}"], row[f"inside{i}"]) for i, span in enumerate(spans)}
    still_open, stuck = {}, False
    for (v, k), (lo, hi) in tighter.items():
        below, inside = counted[v, lo, hi]
        if not below <= k < below + inside or (lo, hi) == brackets[v, k][:2]:
            still_open[v, k] = brackets[v, k]  # missed, or as wide as before: try a finer sketch
            stuck = True
        elif lo == hi:
            found[v, k] = lo
        else:
            still_open[v, k] = Bracket(lo, hi, below, inside)
    return still_open, stuck


def _place(x: float) -> int:
    """The place of a number among all doubles; -0.0 shares that of 0.0."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & (1 << 63) - 1)


def _at(place: int) -> float:
    x = struct.unpack("<d", struct.pack("<q", abs(place)))[0]
    return x if place >= 0 else -x


def _halve(numbers: DataFrame, brackets: dict, found: dict) -> dict:
    """The half of each bracket that holds its rank. A half has half as many doubles, so a bracket is one number after 64 rounds at most."""
    ends = numbers.selectExpr(*[f"{what}({v}) AS {what}_{v}" for v in numbers.columns for what in ("min", "max")]).first()
    cut = {}
    for (v, k), b in brackets.items():
        lo, hi = _place(max(b.lo, ends[f"min_{v}"])), _place(min(b.hi, ends[f"max_{v}"]))
        cut[v, k] = (lo, (lo + hi) // 2, hi)
    spans = sorted({(v, lo, mid) for (v, _), (lo, mid, _) in cut.items()})
    row = numbers.selectExpr(*[f"count_if({v} BETWEEN {sql_double(_at(lo))} AND {sql_double(_at(mid))}) AS n{i}" for i, (v, lo, mid) in enumerate(spans)]).first()
    lower = {span: row[f"n{i}"] for i, span in enumerate(spans)}
    still_open = {}
    for (v, k), (lo, mid, hi) in cut.items():
        b, n = brackets[v, k], lower[v, lo, mid]
        first, last, below, inside = (lo, mid, b.below, n) if k < b.below + n else (mid + 1, hi, b.below + n, b.inside - n)
        if first == last:
            found[v, k] = _at(first)
        else:
            still_open[v, k] = Bracket(_at(first), _at(last), below, inside)
    return still_open
