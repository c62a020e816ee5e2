"""The classifiers by name, as estimators on ``features`` (vector) and ``label`` (0, 1, ...)."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.models.boosting import HistogramBoosting
from tidewatch.models.dense import DenseNetwork
from tidewatch.models.extra_trees import ExtraTrees
from tidewatch.operators.neighbors import nearest, vote, vote_shares

# Hidden layers of the two dense networks, and the usual settings.
DENSE_LAYERS = {
    "vgg16": [512, 512, 256, 256, 128, 128],
    "vgg19": [512, 512, 512, 256, 256, 256, 128, 128, 128],
}
TREE_DEPTH = 20
FOREST_TREES = 100
SVM_ITERATIONS = 1000
SVM_TOLERANCE = 1e-3
EPOCHS = 10


def naive_bayes() -> NaiveBayes:
    """Gaussian, with population variances plus a billionth of the largest one."""
    return NaiveBayes(modelType="gaussian")


def decision_tree(depth: int = TREE_DEPTH, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed)


def random_forest(trees: int = FOREST_TREES, depth: int = TREE_DEPTH, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)


def extra_trees(trees: int = FOREST_TREES, depth: int = TREE_DEPTH, seed: int = 42) -> ExtraTrees:
    return ExtraTrees(trees, depth, seed)


def linear_svm(classes: int = 2, iterations: int = SVM_ITERATIONS):
    """Hinge loss, no probabilities; one against the rest for more than two classes."""
    svm = LinearSVC(maxIter=iterations, tol=SVM_TOLERANCE)
    return svm if classes == 2 else OneVsRest(classifier=svm, parallelism=4)


def boosted_trees(classes: int = 2, rounds: int = 200, depth: int = 7, rate: float = 0.1, seed: int = 42, **settings) -> HistogramBoosting:
    return HistogramBoosting(classes, rounds, depth, rate, seed=seed, **settings)


def dense_network(inputs: int, classes: int, kind: str = "vgg16", epochs: int = EPOCHS, seed: int = 42, **settings) -> DenseNetwork:
    """A stack of fully connected layers ending in a softmax."""
    return DenseNetwork([inputs, *DENSE_LAYERS[kind], classes], epochs, seed=seed, **settings)


class NearestNeighbors:
    """Vote of the k nearest training rows; fitting only keeps the training table."""

    def __init__(self, key: str = "key", k: int = 5):
        self.key, self.k = key, k

    def fit(self, train: DataFrame) -> "NearestNeighborsModel":
        return NearestNeighborsModel(self, train)


class NearestNeighborsModel:
    def __init__(self, settings: NearestNeighbors, train: DataFrame):
        key = settings.key
        self.settings = settings
        self.train = train.select(F.col(key).cast("string").alias(key), vector_to_array("features").alias("__x"), F.col("label").cast("double").alias("__y"))
        self.classes = self._classes()

    def _classes(self) -> list[float]:
        return [float(c) for c in range(int(self.train.agg(F.max("__y")).first()[0]) + 1)]

    def save(self, spark: SparkSession, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(self.settings.key, self.settings.k)], "key string, k int").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NearestNeighborsModel":
        found = spark.read.parquet(f"{path}/settings").first()
        model = cls.__new__(cls)
        model.settings, model.train = NearestNeighbors(found.key, found.k), spark.read.parquet(f"{path}/rows")
        model.classes = model._classes()
        return model

    def transform(self, df: DataFrame) -> DataFrame:
        # Each distinct vector is asked for once, and rows find the answer by their vector: keys may repeat.
        key = self.settings.key
        asked = df.withColumn("__asked", F.md5(F.to_json(vector_to_array("features"))))
        queries = asked.select(F.col("__asked").alias(key), vector_to_array("features").alias("__x"), F.lit(None).cast("double").alias("__y"))
        joined = nearest(queries.dropDuplicates([key]), self.train, key, "__x", self.settings.k, label="__y")
        votes = joined.select(
            F.col(key).alias("__asked"), vote(joined).alias("prediction"), array_to_vector(vote_shares(joined, self.classes)).alias("probability")
        )
        return asked.join(votes, "__asked").drop("__asked")


def standard_models(classes: int, inputs: int, key: str = "key", seed: int = 42) -> dict[str, object]:
    """All models of a comparison run at their documented settings."""
    return {
        "Naive Bayes": naive_bayes(),
        "Decision Tree": decision_tree(seed=seed),
        "Random Forest": random_forest(seed=seed),
        "KNN": NearestNeighbors(key),
        "SVM": linear_svm(classes),
        "Extra Trees": extra_trees(seed=seed),
        "VGG16": dense_network(inputs, classes, "vgg16", seed=seed),
        "VGG19": dense_network(inputs, classes, "vgg19", seed=seed),
    }
