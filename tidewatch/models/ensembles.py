"""Voting, weighted averages, weight search and stacking.

Members write their class scores into separate columns of the same row, so
combining them needs no join.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.metrics import confusion, summary_scores


def argmax(scores: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def normalised(weights: list[float] | None, members: int) -> list[float]:
    weights = weights or [1.0] * members
    return [w / sum(weights) for w in weights]


def weighted_scores(members: list[str], weights: list[Column]) -> Column:
    def add(total: Column, member: str, weight: Column) -> Column:
        return F.zip_with(total, F.col(member), lambda a, b: a + b * weight)

    total = F.transform(F.col(members[0]), lambda x: x * weights[0])
    for member, weight in zip(members[1:], weights[1:]):
        total = add(total, member, weight)
    return total


def soft_vote(df: DataFrame, members: list[str], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of the members' class scores (array columns) and its largest entry."""
    shares = [F.lit(w) for w in normalised(weights, len(members))]
    out = df.withColumn("probability", weighted_scores(members, shares))
    return out.withColumn("prediction", argmax(F.col("probability")))


def hard_vote(df: DataFrame, predictions: list[str], classes: int, weights: list[float] | None = None) -> DataFrame:
    """Weighted majority of the members' predictions."""
    shares = normalised(weights, len(predictions))
    votes = F.array(*[
        sum((F.when(F.col(p) == c, F.lit(w)).otherwise(F.lit(0.0)) for p, w in zip(predictions, shares)), F.lit(0.0))
        for c in range(classes)
    ])
    return df.withColumn("prediction", argmax(votes))


def random_weights(members: int, trials: int, seed: int = 42) -> list[list[float]]:
    """Uniform draws from the simplex."""
    return np.random.default_rng(seed).dirichlet(np.ones(members), trials).tolist()


def score_weights(df: DataFrame, truth: str, members: list[str], weights: list[list[float]]) -> DataFrame:
    """Metrics per weighting; every row is scored once per trial and counted at once, so only counts are shuffled."""
    trials = F.array(*[
        F.struct(F.lit(i).alias("trial"), *[F.lit(float(w)).alias(f"w{j}") for j, w in enumerate(ws)])
        for i, ws in enumerate(weights)
    ])
    tried = df.select(truth, *members, F.explode(trials).alias("t"))
    mixed = weighted_scores(members, [F.col(f"t.w{j}") for j in range(len(members))])
    predicted = tried.select(F.col("t.trial").alias("trial"), F.col(truth).alias("y"), argmax(mixed).alias("pred"))
    return summary_scores(confusion(predicted, "y", "pred", ["trial"]), ["trial"])


def optimise_weights(df: DataFrame, truth: str, members: list[str], trials: int = 100, seed: int = 42) -> tuple[list[float], float]:
    """The weighting with the best weighted F1; the first of equals, uniform weights if none scores above 0."""
    weights = random_weights(len(members), trials, seed)
    best = score_weights(df, truth, members, weights).orderBy(F.desc("f1_weighted"), "trial").first()
    if best is None or best.f1_weighted <= 0:
        return normalised(None, len(members)), 0.0
    return weights[best.trial], best.f1_weighted


def add_scores(df: DataFrame, models: dict[str, object]) -> DataFrame:
    """Class scores and predictions of fitted models side by side: ``name`` (array) and ``name_pred``."""
    out, kept = df, list(df.columns)
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.select(
            *kept, vector_to_array("probability").alias(name), F.col("prediction").cast("int").alias(f"{name}_pred")
        )
        kept += [name, f"{name}_pred"]
    return out


class VotingEnsemble:
    """Fits its members on the same rows and combines their votes."""

    def __init__(self, members: dict[str, object], voting: str = "soft", weights: list[float] | None = None, classes: int = 2):
        self.members, self.voting, self.weights, self.classes = members, voting, weights, classes

    def fit(self, df: DataFrame) -> "VotingModel":
        data = df.persist()
        try:
            return VotingModel({n: m.fit(data) for n, m in self.members.items()}, self.voting, self.weights, self.classes)
        finally:
            data.unpersist()


class VotingModel:
    def __init__(self, models: dict[str, object], voting: str, weights: list[float] | None, classes: int):
        self.models, self.voting, self.weights, self.classes = models, voting, weights, classes

    def optimise(self, validation: DataFrame, trials: int = 100, seed: int = 42) -> float:
        """Take over the best random weighting on held-out rows; returns its weighted F1."""
        scored = add_scores(validation, self.models)
        self.weights, best = optimise_weights(scored, "label", list(self.models), trials, seed)
        return best

    def transform(self, df: DataFrame) -> DataFrame:
        names = list(self.models)
        scored = add_scores(df, self.models)
        if self.voting == "hard":
            voted = hard_vote(scored, [f"{n}_pred" for n in names], self.classes, self.weights)
        else:
            voted = soft_vote(scored, names, self.weights).withColumn("probability", array_to_vector("probability"))
        return voted.withColumn("prediction", F.col("prediction").cast("double")).drop(*names, *[f"{n}_pred" for n in names])


class StackingEnsemble:
    """Out-of-fold class scores of the members feed a logistic regression.

    ``fold`` names a column 0..folds-1. The members are fitted once per fold on the
    other folds, and once more on all rows for later scoring.
    """

    def __init__(self, members: dict[str, object], fold: str, folds: int = 5, classes: int = 2, iterations: int = 1000):
        self.members, self.fold, self.folds, self.classes, self.iterations = members, fold, folds, classes, iterations

    def _assembled(self, scored: DataFrame) -> DataFrame:
        names = list(self.members)
        # Two class scores sum to one, so the positive one says it all.
        parts = [F.slice(n, 2, 1) if self.classes == 2 else F.col(n) for n in names]
        return scored.withColumn("__meta", array_to_vector(F.concat(*parts)))

    def fit(self, df: DataFrame) -> "StackingModel":
        data = df.persist()
        try:
            held_out = None
            for i in range(self.folds):
                fitted = {n: m.fit(data.where(F.col(self.fold) != i)) for n, m in self.members.items()}
                part = add_scores(data.where(F.col(self.fold) == i).select("features", "label"), fitted)
                held_out = part if held_out is None else held_out.unionByName(part)
            meta = LogisticRegression(featuresCol="__meta", maxIter=self.iterations).fit(
                self._assembled(held_out).select("__meta", "label"))
            return StackingModel(self, {n: m.fit(data) for n, m in self.members.items()}, meta)
        finally:
            data.unpersist()


class StackingModel:
    def __init__(self, settings: StackingEnsemble, models: dict[str, object], meta):
        self.settings, self.models, self.meta = settings, models, meta

    def transform(self, df: DataFrame) -> DataFrame:
        names = list(self.models)
        scored = self.settings._assembled(add_scores(df, self.models))
        return self.meta.transform(scored).drop("__meta", *names, *[f"{n}_pred" for n in names])
