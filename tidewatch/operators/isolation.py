"""Outlier scores by isolation trees: rows that random cuts set apart early are unusual."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.numeric import quoted
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.session import cut_lineage

# Usual settings.
TREES, SAMPLE = 100, 256
EULER = 0.5772156649015329


def mean_depth(rows: np.ndarray | int) -> np.ndarray:
    """The mean depth at which a search tree of so many rows ends without success."""
    n = np.asarray(rows, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree over a sample, as (feature, cut, depth of a leaf) in the layout of a complete tree; feature is -1 in leaves.

    A node draws one of the features that vary in it and a cut between their ends. What a node draws depends on the seed and its place only.
    """
    deepest = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes = (1 << (deepest + 1)) - 1
    feature, cut, ends = np.full(nodes, -1, np.int64), np.zeros(nodes), np.zeros(nodes)
    open_ = [(0, 0, np.arange(len(x)))]
    while open_:
        place, depth, rows = open_.pop()
        part = np.where(np.isfinite(x[rows]), x[rows], np.nan)
        known = ~np.isnan(part).all(axis=0) if len(rows) else np.zeros(x.shape[1], bool)
        low, high = np.where(known, np.nan, 0.0), np.where(known, np.nan, 0.0)
        if known.any():
            low[known], high[known] = np.nanmin(part[:, known], axis=0), np.nanmax(part[:, known], axis=0)
        varies = np.flatnonzero(high > low)
        if depth == deepest or not len(varies):
            ends[place] = depth + mean_depth(len(rows))
            continue
        draw = np.random.default_rng([*seed, place])
        f = int(draw.choice(varies))
        feature[place], cut[place] = f, low[f] + draw.random() * (high[f] - low[f])
        left = x[rows, f] <= cut[place]
        open_ += [(2 * place + 1, depth + 1, rows[left]), (2 * place + 2, depth + 1, rows[~left])]
    return feature, cut, ends


def _filled(feature: np.ndarray, cut: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree whose leaves above the last level hand their depth on to all that would lie below them, so every row takes the same steps."""
    ends = ends.copy()
    leaf = feature < 0
    for place in range(len(ends) // 2):  # a parent's number is smaller than its children's
        if leaf[place]:
            ends[2 * place + 1: 2 * place + 3] = ends[place]
            leaf[2 * place + 1: 2 * place + 3] = True
    return np.maximum(feature, 0), cut, ends


class IsolationForest:
    """``trees`` trees over samples of ``sample`` rows each, and the score above which a row is an outlier.

    The samples come from the trees x sample rows with the smallest hash of their content, which is all the driver holds. ``share`` is the part of the
    fitted rows to call outliers, by the exact quantile of their scores; without it, scores above 0.5 are. Equal rows always get equal answers, so
    ties at the quantile are all kept in. Missing and infinite values go to the right of every cut.
    """

    def __init__(self, columns: list[str], trees: int = TREES, sample: int = SAMPLE, share: float | None = None, seed: int = 42):
        self.columns, self.trees, self.sample, self.share, self.seed = columns, trees, sample, share, seed

    def fit(self, df: DataFrame) -> "IsolationForestModel":
        values = df.select(*[F.col(quoted(c)).cast("double").alias(f"v{i}") for i, c in enumerate(self.columns)])
        names = values.columns
        pool = values.orderBy(F.xxhash64(F.lit(self.seed), *names), *names).limit(self.trees * self.sample).collect()
        x = np.array([[np.nan if v is None else v for v in r] for r in pool], float).reshape(len(pool), len(names))
        forest = []
        for t in range(self.trees):
            drawn = np.sort(np.random.default_rng([self.seed, t]).permutation(len(x))[: self.sample])
            forest.append(grow(x[drawn], [self.seed, t]))
        model = IsolationForestModel(self.columns, forest, min(self.sample, len(x)), 0.5, {})
        scored = cut_lineage(model.scored(values.toDF(*self.columns)))  # scores are worked out once, then read by every pass
        if self.share is not None and len(x):
            model.limit = exact_quantiles(scored, ["outlier_score"], [1 - self.share])["outlier_score"][0]
        usual = scored.where(F.col("outlier_score") <= model.limit)
        ends = usual.select(*[f(F.when(~F.isnan(quoted(c)), F.col(quoted(c)).cast("double"))).alias(f"{n}{i}")
                              for i, c in enumerate(self.columns) for n, f in (("low", F.min), ("high", F.max))]).first()
        model.ranges = {c: (ends[f"low{i}"], ends[f"high{i}"]) for i, c in enumerate(self.columns)}
        return model


class IsolationForestModel:
    def __init__(self, columns: list[str], forest: list[tuple], sample: int, limit: float, ranges: dict[str, tuple]):
        self.columns, self.forest, self.sample, self.limit, self.ranges = columns, forest, sample, limit, ranges

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds ``outlier_score``: 2 to the minus (mean depth by the usual depth of the sample); near 1 is unusual, below 0.5 is not."""
        forest, usual, width = self.forest, float(mean_depth(self.sample)) or 1.0, len(self.columns)

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.array([c.to_numpy(dtype=float, na_value=np.nan) for c in columns]).reshape(width, -1)
            rows, total, values = np.arange(x.shape[1]), np.zeros(x.shape[1]), x.ravel()
            for feature, cut, ends in trees:
                at, starts = np.zeros(x.shape[1], np.int64), feature * x.shape[1]
                for _ in range(int(math.log2(len(ends) + 1)) - 1):
                    left = values.take(starts.take(at) + rows) <= cut.take(at)
                    at *= 2
                    at += 2
                    at -= left
                total += ends.take(at)
            return pd.Series(np.round(2.0 ** (-total / max(1, len(trees)) / usual), 12))

        trees = [_filled(*t) for t in forest]
        return df.withColumn("outlier_score", score(*[F.col(quoted(c)).cast("double") for c in self.columns]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``outlier_score`` and ``is_outlier``."""
        return self.scored(df).withColumn("is_outlier", F.col("outlier_score") > self.limit)

    def clip(self, df: DataFrame) -> DataFrame:
        """Values of outliers move into the range of the other rows of the fit; everything else stays. Missing values stay missing."""
        out = self.transform(df)
        moved = {}
        for c, (low, high) in self.ranges.items():
            if low is not None:
                value = F.col(quoted(c)).cast("double")
                moved[c] = F.when(F.col("is_outlier") & value.isNotNull() & ~F.isnan(value), F.least(F.greatest(value, F.lit(low)), F.lit(high))).otherwise(value)
        return out.withColumns(moved).drop("outlier_score", "is_outlier")

    def save(self, spark: SparkSession, path: str) -> None:
        info = {"columns": self.columns, "sample": self.sample, "limit": self.limit, "ranges": self.ranges, "forest": [[a.tolist() for a in t] for t in self.forest]}
        spark.createDataFrame([(json.dumps(info),)], "info string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForestModel":
        info = json.loads(spark.read.parquet(path).first().info)
        forest = [(np.array(f, np.int64), np.array(c, float), np.array(e, float)) for f, c, e in info["forest"]]
        return cls(info["columns"], forest, info["sample"], info["limit"], {c: tuple(r) for c, r in info["ranges"].items()})
