"""Dense networks with rectified units, trained by minibatch steps.

A step needs the weights of the step before and takes a few hundredths of a second, less than a job or an exchange of weights, so an epoch is one job whose one
task gets the rows batch after batch, takes the Adam steps on its way and returns the weights. The rows of a batch are shared by as many threads as an
executor has cores. Held-out rows are looked at by all tasks. What the driver and the tasks hold is the weights and a piece of a batch, whatever the number of rows.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage, executor_cores

#: First rows of a batch's gradient that one task handles at a time.
ROWS_AT_ONCE = 4096
#: Rows that are worth a thread.
THREAD_ROWS = 64
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7

Weights = list[tuple[np.ndarray, np.ndarray]]


def starting(layers: list[int], seed: int) -> Weights:
    """Normal weights with variance 2 / inputs, no bias; a layer's draw depends on the seed and its place only."""
    return [(np.random.default_rng([seed, i]).standard_normal((a, b)) * math.sqrt(2 / a), np.zeros(b)) for i, (a, b) in enumerate(zip(layers, layers[1:]))]


def forward(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The outputs of all layers, the last one as class chances."""
    out = [x]
    for i, (w, b) in enumerate(weights):
        z = out[-1] @ w
        z += b
        if i < len(weights) - 1:
            out.append(np.maximum(z, 0, out=z))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
    return out


def gradients(weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Sums over the rows of the derivatives of the log loss, and (loss, right answers, rows)."""
    found = [(np.empty_like(w), np.empty_like(b)) for w, b in weights]
    return found, _add_gradients(weights, x, y, found, True)


def _add_gradients(weights: Weights, x: np.ndarray, y: np.ndarray, place: Weights, fresh: bool) -> np.ndarray:
    """The gradients are put into ``place``, or added to what is there if it is not ``fresh``; returns (loss, right answers, rows)."""
    out = forward(weights, x)
    p, rows = out[-1], np.arange(len(y))
    told = np.array([-np.log(np.maximum(p[rows, y], 1e-300)).sum(), (p.argmax(axis=1) == y).sum(), len(y)], float)
    delta = p
    delta[rows, y] -= 1
    for i in range(len(weights) - 1, -1, -1):
        w, b = place[i]
        if fresh:
            np.matmul(out[i].T, delta, out=w)
            b[:] = delta.sum(axis=0)
        else:
            w += out[i].T @ delta
            b += delta.sum(axis=0)
        if i:
            delta = delta @ weights[i][0].T
            delta *= out[i] > 0
    return told


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in weights for a in pair])


def _shaped(flat: np.ndarray, layers: list[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at: at + a * b].reshape(a, b), flat[at + a * b: at + a * b + b]))
        at += a * b + b
    return out


class _Steps:
    """The weights, both moments and the number of steps, moved on batch by batch. Each thread has a place for the gradients of its rows, used again and again."""

    def __init__(self, layers: list[int], rate: float, threads: int, state: tuple):
        self.layers, self.rate, self.threads = layers, rate, threads
        self.flat, self.mean, self.square, self.step = *(a.copy() for a in state[:3]), state[3]
        self.pool = ThreadPoolExecutor(threads)
        self.told, self.seen = np.zeros(3), np.zeros(3)
        self.slopes, self.used = [np.zeros_like(self.flat) for _ in range(threads)], 0
        cuts = np.linspace(0, len(self.flat), threads + 1).astype(int)
        self.pieces = [slice(*c) for c in zip(cuts, cuts[1:])]

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """The gradients of some rows of the batch."""
        weights = _shaped(self.flat, self.layers)
        parts = max(1, min(self.threads, len(y) // THREAD_ROWS))
        ends = np.linspace(0, len(y), parts + 1).astype(int)

        def one(t: int) -> np.ndarray:
            part, fresh = slice(ends[t], ends[t + 1]), t >= self.used
            place = _shaped(self.slopes[t], self.layers)
            return _add_gradients(weights, x[part], y[part], place, fresh)

        self.seen += sum(self.pool.map(one, range(parts)))
        self.used = max(self.used, parts)

    def _move(self, at: slice) -> None:
        """The step of some of the weights, in place."""
        slope = self.slopes[0][at]
        for more in self.slopes[1: self.used]:
            slope += more[at]
        slope /= self.seen[2]
        mean, square = self.mean[at], self.square[at]
        mean *= BETA1
        mean += (1 - BETA1) * slope
        slope *= slope
        slope *= 1 - BETA2
        square *= BETA2
        square += slope
        root = np.sqrt(square / (1 - BETA2**self.step))
        root += EPSILON
        np.divide(mean, root, out=root)
        root *= self.rate / (1 - BETA1**self.step)
        self.flat[at] -= root

    def take(self) -> None:
        """The step of the batch that was added up."""
        if self.seen[2]:
            self.step += 1
            list(self.pool.map(self._move, self.pieces))
        self.told += self.seen
        self.seen[:], self.used = 0, 0


class DenseNetwork:
    """Fully connected layers ending in a softmax, on ``features`` and ``label`` (0, 1, ...).

    An epoch takes every training row once, in batches of about ``batch`` rows; which batch a row is in comes from a hash of its content and the
    seed. ``validation`` names a boolean column of rows that are only looked at after each epoch.
    """

    def __init__(self, layers: list[int], epochs: int = 30, batch: int = 1024, rate: float = 1e-3, validation: str | None = None, seed: int = 42):
        self.layers, self.epochs, self.batch, self.rate, self.validation, self.seed = layers, epochs, batch, rate, validation, seed

    def fit(self, df: DataFrame) -> "DenseModel":
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        rows = df.where("label IS NOT NULL").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), held.alias("held"))
        rows = cut_lineage(rows)
        n = rows.where("NOT held").count()
        if not n:
            raise ValueError("no labelled rows")
        batches = max(1, math.ceil(n / self.batch))
        train = rows.where("NOT held").withColumn("batch", F.pmod(F.xxhash64("x", "y", F.lit(self.seed)), F.lit(batches)))
        train = cut_lineage(train.select("x", "y", "batch"))
        checked = rows.where("held").persist() if self.validation else None
        flat = _flat(starting(self.layers, self.seed))
        state, history = (flat, np.zeros_like(flat), np.zeros_like(flat), 0), []
        try:
            for epoch in range(self.epochs):
                state, told = self._epoch(train, np.random.default_rng([self.seed, epoch]).permutation(batches), state)
                val = self._pass(checked, state[0]) if checked is not None else np.zeros(3)
                share = lambda part, of: float(part / of) if of else None
                history.append((epoch + 1, share(told[0], told[2]), share(told[1], told[2]), share(val[0], val[2]), share(val[1], val[2])))
        finally:
            if checked is not None:
                checked.unpersist()
        return DenseModel(self.layers, state[0], history)

    def _epoch(self, train: DataFrame, order: np.ndarray, state: tuple) -> tuple[tuple, np.ndarray]:
        """The weights, moments and steps after an epoch over the batches in this order, and (loss, right answers, rows)."""
        layers, rate, spark = self.layers, self.rate, train.sparkSession
        threads, sent = executor_cores(spark), spark.sparkContext.broadcast(state)
        turns = spark.createDataFrame(pd.DataFrame({"batch": order.astype("int64"), "turn": np.arange(len(order), dtype="int64")}))

        def run(batches):
            steps, now = _Steps(layers, rate, threads, sent.value), None
            for batch in batches:
                turn, y = batch.column("turn").to_numpy(), batch.column("y").to_numpy()
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, layers[0])
                starts = np.flatnonzero(np.diff(turn, prepend=-1))
                for start, end in zip(starts, [*starts[1:], len(turn)]):
                    if turn[start] != now:
                        steps.take()
                        now = turn[start]
                    for at in range(start, end, ROWS_AT_ONCE):
                        steps.add(x[at: min(end, at + ROWS_AT_ONCE)], y[at: min(end, at + ROWS_AT_ONCE)])
            steps.take()
            arrays = [steps.flat, steps.mean, steps.square, np.array([steps.step], float), steps.told]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names)

        names = ["flat", "mean", "square", "step", "told"]
        ordered = train.join(F.broadcast(turns), "batch").select("turn", "x", "y").coalesce(1).sortWithinPartitions("turn")
        try:
            found = ordered.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).toArrow()
        finally:
            sent.destroy()
        flat, mean, square, step, told = (np.frombuffer(found.column(c)[0].as_buffer()).copy() for c in names)
        return (flat, mean, square, int(step[0])), told

    def _pass(self, rows: DataFrame, flat: np.ndarray) -> np.ndarray:
        """(loss, right answers, rows) of held-out rows."""
        layers = self.layers
        sent = rows.sparkSession.sparkContext.broadcast(flat)

        def run(batches):
            weights, told = _shaped(sent.value, layers), np.zeros(3)
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(start, ROWS_AT_ONCE)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, layers[0])
                    y = part.column("y").to_numpy()
                    p = forward(weights, x)[-1]
                    told += np.array([-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), (p.argmax(axis=1) == y).sum(), len(y)], float)
            yield pa.RecordBatch.from_arrays([pa.array([told.tobytes()], pa.binary())], ["told"])

        try:
            found = rows.select("x", "y").mapInArrow(run, "told binary").toArrow()
        finally:
            sent.destroy()
        return sum((np.frombuffer(t.as_buffer()) for t in found.column("told")), np.zeros(3))


class DenseModel:
    """Weights, and ``history`` with (epoch, loss, accuracy, val_loss, val_accuracy)."""

    def __init__(self, layers: list[int], flat: np.ndarray, history: list[tuple]):
        self.layers, self.flat, self.history = layers, flat, history

    def transform(self, df: DataFrame) -> DataFrame:
        layers, sent = self.layers, df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            x = np.array(features.tolist(), float).reshape(len(features), layers[0])
            return pd.Series(list(forward(_shaped(sent.value, layers), x)[-1]))

        scored = df.withColumn("__p", probabilities(vector_to_array("features")))
        best = F.array_position("__p", F.array_max("__p")).cast("double") - 1
        return scored.withColumns({"probability": array_to_vector("__p"), "prediction": best}).drop("__p")

    def save(self, spark: SparkSession, path: str) -> None:
        info = json.dumps({"layers": self.layers, "history": self.history})
        spark.createDataFrame([(info, bytearray(self.flat.astype("<f8").tobytes()))], "info string, weights binary").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DenseModel":
        row = spark.read.parquet(path).first()
        info = json.loads(row.info)
        return cls(info["layers"], np.frombuffer(bytes(row.weights), "<f8").copy(), [tuple(h) for h in info["history"]])
