"""A smooth-kernel classifier that scales: random Fourier features and a linear model on top.

The lifted rows are many times as wide as the rows, so they are never stored: the logistic fit takes Newton steps, and each pass over the rows lifts them on the way
and adds up loss, gradient and second derivatives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: Rows that are lifted at a time.
ROWS_AT_ONCE = 4096
#: Sums of all tasks that the driver may add itself; beyond it they are added in Spark first.
DRIVER_BYTES = 64 << 20
#: Least gain of a Newton step, as a share of the loss, and halvings of a step that gains nothing.
TOLERANCE, HALVINGS = 1e-6, 20


class KernelClassifier:
    """Approximates an RBF kernel of width ``gamma`` (1 / (columns x variance) by default)."""

    def __init__(self, components: int = 256, gamma: float | None = None, penalty: float = 1e-4, iterations: int = 100, seed: int = 42):
        self.components, self.gamma, self.penalty, self.iterations, self.seed = components, gamma, penalty, iterations, seed

    def fit(self, df: DataFrame) -> "KernelModel":
        moments = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col("features")).alias("s")).first().s
        mean, square = moments.mean.toArray(), moments.normL2.toArray() ** 2 / moments["count"]
        spread = square.mean() - mean.mean() ** 2  # variance over all entries of the matrix
        gamma = self.gamma or 1.0 / (len(mean) * (spread or 1.0))
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(scale=np.sqrt(2 * gamma), size=(len(mean), self.components))
        offsets = rng.uniform(0, 2 * np.pi, self.components)
        lift = _lift(df.sparkSession, directions, offsets)
        rows = cut_lineage(df.where("label IS NOT NULL").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y")))
        return KernelModel(lift, self._linear(rows, directions, offsets), directions, offsets)

    def _linear(self, rows: DataFrame, directions: np.ndarray, offsets: np.ndarray) -> LogisticRegressionModel:
        """The logistic model with the least mean log loss and penalty on the lifted rows; a weight counts for the penalty by the deviation of its column."""
        sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            raise ValueError("no labelled rows")
        classes, n, wide = max(2, max(sizes) + 1), sum(sizes.values()), self.components + 1
        scores = 1 if classes == 2 else classes
        moments = _summed(rows, directions, offsets, lambda z, y: np.stack([z.sum(0), (z**2).sum(0)]), (2, wide))
        spread = (moments[1] - moments[0] ** 2 / n) / max(1, n - 1)
        penalty = self.penalty * np.append(np.maximum(spread[:-1], 0), 0)  # none on the constant
        share = np.array([max(sizes.get(c, 0), 1e-9) for c in range(classes)]) / n
        weights = np.zeros((scores, wide))
        weights[:, -1] = np.log(share[1:] / share[:1]) if scores == 1 else np.log(share) - np.log(share).mean()
        shape = (1 + scores * wide + (scores * wide) ** 2,)
        best, step, halved = None, np.zeros_like(weights), 0
        for _ in range(self.iterations + 1):
            found = _summed(rows, directions, offsets, _slopes(weights, scores), shape) / n
            loss = found[0] + (penalty * weights**2).sum() / 2
            if best is not None and not loss <= best[0]:
                halved += 1
                if halved > HALVINGS:
                    break
                step /= 2
                weights = best[1] + step
                continue
            done = best is not None and best[0] - loss <= TOLERANCE * max(abs(loss), 1e-12)
            best, halved = (loss, weights), 0
            if done:
                break
            slope = found[1: 1 + scores * wide] + np.tile(penalty, scores) * weights.ravel()
            curve = found[1 + scores * wide:].reshape(scores * wide, -1) + np.diag(np.tile(penalty, scores) + 1e-9)
            step = -np.linalg.solve(curve, slope).reshape(weights.shape)
            weights = weights + step
        return _logistic(rows.sparkSession, best[1], classes)


def _slopes(weights: np.ndarray, scores: int):
    """Sums of log loss, gradient and second derivatives over some lifted rows, one after the other in an array."""

    def add(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        logits = z @ weights.T
        if scores == 1:
            logits = np.hstack([np.zeros_like(logits), logits])
        logits -= logits.max(axis=1, keepdims=True)
        total = np.log(np.exp(logits).sum(axis=1, keepdims=True))
        p, rows = np.exp(logits - total), np.arange(len(y))
        loss = (total[:, 0] - logits[rows, y]).sum()
        off = p.copy()
        off[rows, y] -= 1
        off, p = (off[:, 1:], p[:, 1:]) if scores == 1 else (off, p)
        wide, curve = z.shape[1], np.empty((scores, z.shape[1], scores, z.shape[1]))
        for a in range(scores):
            for b in range(a, scores):
                curve[a, :, b] = z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                curve[b, :, a] = curve[a, :, b].T
        return np.concatenate([[loss], (off.T @ z).ravel(), curve.reshape(scores * wide, -1).ravel()])

    return add


def _summed(rows: DataFrame, directions: np.ndarray, offsets: np.ndarray, add, shape: tuple) -> np.ndarray:
    """What ``add`` finds in lifted rows (with a last column of ones) and their classes, added up over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((directions, offsets))

    def run(batches):
        (w, b), total = sent.value, np.zeros(shape)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
            y = batch.column("y").to_numpy()
            for at in range(0, len(y), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                z = np.ones((len(y[part]), len(b) + 1))
                z[:, :-1] = _cosines(x[part], w, b)
                total += add(z, y[part])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(np.frombuffer(v) for v in part["sums"]).tobytes()]})

    parts, tasks = rows.mapInArrow(run, "sums binary"), rows.rdd.getNumPartitions()
    if tasks * int(np.prod(shape)) * 8 > DRIVER_BYTES:
        packs = parts.withColumn("pack", F.pmod(F.spark_partition_id(), F.lit(math.ceil(math.sqrt(tasks)))))
        parts = packs.groupBy("pack").applyInPandas(merged, "sums binary")
    try:
        found = parts.toArrow().column("sums")
    finally:
        sent.destroy()
    return sum((np.frombuffer(v.as_buffer()) for v in found), np.zeros(int(np.prod(shape)))).reshape(shape)


def _logistic(spark: SparkSession, weights: np.ndarray, classes: int) -> LogisticRegressionModel:
    """Spark's model with these weights, the constant last."""
    context, flat = spark.sparkContext, weights[:, :-1]
    if len(weights) > 1:  # the same answers from any common shift of the constants
        weights = weights - np.append(np.zeros(flat.shape[1]), weights[:, -1].mean())
    matrix = DenseMatrix(*flat.shape, flat.ravel().tolist(), True)
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "kernel_logistic", _py2java(context, matrix), _py2java(context, DenseVector(weights[:, -1].tolist())), classes, len(weights) > 1)
    return LogisticRegressionModel(made).setFeaturesCol("__lifted")


def _cosines(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(b)) * np.cos(x @ w + b)


def _lift(spark, directions: np.ndarray, offsets: np.ndarray):
    shared = spark.sparkContext.broadcast((directions, offsets))

    @F.pandas_udf("array<double>")
    def cosines(features: pd.Series) -> pd.Series:
        w, b = shared.value
        x = np.array(features.tolist(), dtype=float)
        return pd.Series(list(_cosines(x, w, b)))

    def lift(df: DataFrame) -> DataFrame:
        return df.withColumn("__lifted", array_to_vector(cosines(vector_to_array("features"))))

    return lift


class KernelModel:
    def __init__(self, lift, linear, directions: np.ndarray, offsets: np.ndarray):
        self.lift, self.linear, self.directions, self.offsets = lift, linear, directions, offsets

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self.lift(df)).drop("__lifted")

    def save(self, spark: SparkSession, path: str) -> None:
        self.linear.write().overwrite().save(f"{path}/linear")
        rows = [(self.directions.tolist(), self.offsets.tolist())]
        spark.createDataFrame(rows, "directions array<array<double>>, offsets array<double>").write.mode("overwrite").parquet(f"{path}/lift")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KernelModel":
        row = spark.read.parquet(f"{path}/lift").first()
        directions, offsets = np.array(row.directions), np.array(row.offsets)
        return cls(_lift(spark, directions, offsets), LogisticRegressionModel.load(f"{path}/linear"), directions, offsets)
