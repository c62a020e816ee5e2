"""Feature scores and feature selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import quoted
from tidewatch.operators.encode import column_statistics
from tidewatch.operators.prefix import bucket_of
from tidewatch.operators.quantiles import exact_quantiles

# Defaults of the selector.
VARIANCE_ABOVE = 0.01
CORRELATION_ABOVE = 0.95
RFE_STEP = 0.1
FOREST_TREES = 100


def _per_class(df: DataFrame, columns: list[str], label: str, **statistics) -> DataFrame:
    """(feature, position, class, and each statistic) from one aggregation with one row per class."""
    numbers = [F.col(quoted(c)).cast("double") for c in columns]
    wide = df.groupBy(F.col(label).alias("cls")).agg(*[f(x).alias(f"{name}{i}") for i, x in enumerate(numbers) for name, f in statistics.items()])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), *[F.col(f"{name}{i}").alias(name) for name in statistics])
        for i, c in enumerate(columns)
    ])
    return wide.select("cls", F.explode(cells).alias("c")).select("cls", "c.*")


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Between-class over within-class variance; null for a constant feature.

    Both come from means and variances per class, so a large common offset does not swamp them.
    """
    classes = _per_class(df, columns, label, n=F.count, mean=F.avg, var=F.var_pop, lo=F.min, hi=F.max).where("n > 0")
    whole = classes.groupBy("feature", "position").agg(
        F.count(F.lit(1)).cast("double").alias("classes"), F.sum("n").cast("double").alias("rows"), F.sum(F.col("n") * F.col("var")).alias("within"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gaps = classes.select("feature", "n", "mean").join(whole.select("feature", "grand"), "feature").groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"))
    score = F.try_divide(F.col("between") / (F.col("classes") - 1), F.col("within") / (F.col("rows") - F.col("classes")))
    return whole.join(gaps, "feature", "left").select("feature", "position", F.when(F.col("lo") < F.col("hi"), score).alias("score"))


def chi2_score(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Chi-square of per-class sums of absolute values against class share times total."""
    sums = _per_class(df, columns, label, n=lambda x: F.count(F.lit(1)), s=lambda x: F.sum(F.abs(x)))
    totals = sums.groupBy("feature", "position").agg(F.sum("s").alias("total"), F.sum("n").alias("rows"))
    expected = F.col("n") / F.col("rows") * F.col("total")
    term = F.try_divide((F.col("s") - expected) * (F.col("s") - expected), expected)
    return sums.join(totals, ["feature", "position"]).groupBy("feature", "position").agg(F.sum(term).alias("score"))


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of quantile-binned values with the class, in nats.

    Rows are expanded to one (feature, bin, class) each and counted before any
    shuffle, so at most features x bins x classes rows leave a task.
    """
    edges = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                 bucket_of(quoted(c), sorted({e for e in edges[c] if e is not None})).alias("bin"))
        for i, c in enumerate(columns)
    ])
    joint = (
        df.select(F.col(label).alias("cls"), F.explode(cells).alias("c")).select("cls", "c.*")
        .groupBy("feature", "position", "bin", "cls").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    per_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    per_class = joint.groupBy("feature", "cls").agg(F.sum("n").alias("n_cls"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("rows"))
    joined = joint.join(per_bin, ["feature", "bin"]).join(per_class, ["feature", "cls"]).join(total, "feature")
    term = F.col("n") / F.col("rows") * F.log(F.col("n") * F.col("rows") / (F.col("n_bin") * F.col("n_cls")))
    return joined.groupBy("feature", "position").agg(F.sum(term).alias("score"))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variances."""
    row = df.agg(*[F.var_pop(F.col(quoted(c)).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"v{i}").alias("score"))
        for i, c in enumerate(columns)
    ])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="error").transform(df)


def correlation_kept(df: DataFrame, columns: list[str], above: float = CORRELATION_ABOVE) -> list[str]:
    """Columns left when each one too correlated with an earlier kept column is dropped."""
    vectors = assemble(df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in columns]), columns, "__v")
    matrix = Correlation.corr(vectors, "__v").head()[0].toArray()
    kept: list[int] = []
    for j in range(len(columns)):
        if not any(abs(matrix[i][j]) > above for i in kept):
            kept.append(j)
    return [columns[j] for j in kept]


def forest_importances(df: DataFrame, columns: list[str], label: str, trees: int = FOREST_TREES, seed: int = 42, **params) -> list[float]:
    forest = RandomForestClassifier(labelCol=label, featuresCol="__f", numTrees=trees, seed=seed, **params)
    return list(forest.fit(assemble(df, columns, "__f")).featureImportances.toArray())


def recursive_elimination(
    df: DataFrame, columns: list[str], label: str, keep: int, step: float = RFE_STEP, **forest
) -> list[str]:
    """Refit a forest and drop the least important tenth until ``keep`` columns are left."""
    kept = list(columns)
    drop = max(1, int(step * len(columns)))
    data = df.select(label, *columns).persist()
    try:
        while len(kept) > keep:
            importance = forest_importances(data, kept, label, **forest)
            worst = sorted(range(len(kept)), key=lambda i: (importance[i], -i))[: min(drop, len(kept) - keep)]
            kept = [c for i, c in enumerate(kept) if i not in set(worst)]
    finally:
        data.unpersist()
    return kept


@dataclass
class FeatureSelection:
    """A fitted choice of columns, with scores where the method has any."""

    method: str
    selected: list[str]
    scores: list[tuple[str, float | None]] | None = None
    model: object = field(default=None, repr=False)

    def transform(self, df: DataFrame, keep: list[str] = []) -> DataFrame:
        if self.method == "pca":
            return self.model.transform(df)
        return df.select(*keep, *[F.col(quoted(c)) for c in self.selected])

    def slicer(self, columns: list[str]) -> VectorSlicer:
        """The same choice for an assembled vector."""
        return VectorSlicer(inputCol="features", outputCol="selected", indices=[columns.index(c) for c in self.selected])

    def top_features(self, k: int = 20) -> list[tuple[str, float]] | None:
        if self.scores is None:
            return None
        scored = [(c, s) for c, s in self.scores if s is not None and s == s]
        return sorted(scored, key=lambda p: (-p[1], p[0]))[:k]


SCORERS = {"mutual_info": mutual_information, "chi2": chi2_score, "f_classif": anova_f}


def fit_selection(
    df: DataFrame, columns: list[str], label: str, method: str = "mutual_info", n_features: int = 40, seed: int = 42, **params
) -> FeatureSelection:
    k = min(n_features, len(columns))
    if method in SCORERS:
        scores = {r.feature: r.score for r in SCORERS[method](df, columns, label, **params).collect()}
        ranked = sorted(columns, key=lambda c: (-(scores[c] if scores[c] is not None else float("-inf")), columns.index(c)))
        chosen = set(ranked[:k])
        return FeatureSelection(method, [c for c in columns if c in chosen], [(c, scores[c]) for c in columns])
    if method == "variance":
        found = {r.feature: r.score for r in variances(df, columns).collect()}
        return FeatureSelection(method, [c for c in columns if found[c] is not None and found[c] > VARIANCE_ABOVE])
    if method == "model_based":
        importance = forest_importances(df, columns, label, seed=seed, **params)
        ranked = sorted(range(len(columns)), key=lambda i: (-importance[i], i))
        chosen = set(ranked[:k])
        return FeatureSelection(method, [c for i, c in enumerate(columns) if i in chosen], list(zip(columns, importance)))
    if method == "rfe":
        return FeatureSelection(method, recursive_elimination(df, columns, label, k, seed=seed, **params))
    if method == "pca":
        return FeatureSelection(method, [f"pc{i}" for i in range(k)], model=fit_pca(df, columns, k))
    raise ValueError(f"unknown selection method: {method}")


class CentredPca:
    """Principal components of centred columns; each axis points to its largest loading."""

    def __init__(self, columns: list[str], means: list[float], model):
        self.columns, self.means, self.model = columns, means, model
        loadings = model.pc.toArray()
        self.signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]

    def centre(self, df: DataFrame) -> DataFrame:
        shifted = df.withColumns({
            f"__c{i}": F.col(quoted(c)).cast("double") - F.lit(m) for i, (c, m) in enumerate(zip(self.columns, self.means))
        })
        names = [f"__c{i}" for i in range(len(self.columns))]
        return assemble(shifted, names, "__centred").drop(*names)

    def transform(self, df: DataFrame) -> DataFrame:
        projected = self.model.transform(self.centre(df)).withColumn("__a", vector_to_array("__pc"))
        return projected.withColumns(
            {f"pc{i}": F.get("__a", i) * F.lit(s) for i, s in enumerate(self.signs)}
        ).drop("__a", "__pc", "__centred")


def fit_pca(df: DataFrame, columns: list[str], k: int) -> CentredPca:
    stats = column_statistics(df, columns)
    means = [stats[c]["mean"] or 0.0 for c in columns]
    shifted = df.select(*[(F.col(quoted(c)).cast("double") - F.lit(m)).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, means))])
    vectors = assemble(shifted, shifted.columns, "__centred")
    return CentredPca(columns, means, PCA(k=k, inputCol="__centred", outputCol="__pc").fit(vectors))
