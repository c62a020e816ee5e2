"""Text quality by naive Bayes support vectors: indicators scaled by class log-count ratios, hinge loss, dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts
from tidewatch.llm.registry import query, table

#: Bound on the labelled rows a fit sees; they are the first by hash of their id.
SAMPLE = 8000
HALF = 1 << 17
SIZE = 2 * HALF
#: The kind of each byte: capital, small letter (or part of a letter beyond ASCII), digit, white space, or the mark itself.
KIND = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in b" \t\n\v\f\r" else c
                 for c in range(256)], np.uint8)
POWERS = np.power(np.uint32(16777619), np.arange(1, 257, dtype=np.uint32))
BLOCK = 1 << 20


class Indicators:
    """Distinct hashed n-grams of a whole text: three bytes each, and one to three word shapes in a row.

    A shape keeps the kinds of characters and the marks of a word (``Word!!`` is ``Aa!``) and tells whether the word repeats the one before.
    """

    def __init__(self):
        self.seen = np.zeros(SIZE, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        data, before, last = (text or "").encode("utf-8", "surrogatepass"), np.zeros(2, np.uint32), np.zeros(1, np.uint32)
        for start in range(0, len(data), BLOCK):
            letters = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - start), start)
            kinds = KIND[letters]
            letters = np.where(kinds == 32, np.uint8(32), letters)
            letters = np.concatenate([[np.uint8(32)], letters, [np.uint8(32)]])
            kinds = np.concatenate([[np.uint8(32)], kinds, [np.uint8(32)]])
            once = np.ones(len(letters), bool)
            once[1:] = (kinds[1:] != 32) | (kinds[:-1] != 32)
            letters, kinds = letters[once], kinds[once]
            wide = letters.astype(np.uint32)
            grams = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            self.seen[(grams * np.uint32(2654435761)) >> np.uint32(15)] = True
            once[: len(kinds) - 1] = kinds[1:] != kinds[:-1]
            words, shapes = _hashes(wide, kinds), _hashes(kinds[:-1][once[: len(kinds) - 1]].astype(np.uint32), kinds[:-1][once[: len(kinds) - 1]])
            if not len(words):
                continue
            codes = np.concatenate([before, shapes * np.uint32(2) + (words == np.concatenate([last, words[:-1]]))])
            mixed = codes[2:] * np.uint32(2654435761)
            self._mark(mixed)
            mixed = (mixed ^ codes[1:-1]) * np.uint32(2246822519)
            self._mark(mixed)
            self._mark((mixed ^ codes[:-2]) * np.uint32(3266489917))
            last, before = words[-1:], codes[-2:]
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)

    def _mark(self, mixed: np.ndarray) -> None:
        self.seen[(mixed >> np.uint32(15)) + np.uint32(HALF)] = True


def _hashes(values: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """One hash for each run of bytes that are not white space."""
    inside = np.concatenate([[False], kinds != 32])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    if not len(starts):
        return np.zeros(0, np.uint32)
    values, inside = values[starts[0]:], inside[1 + starts[0]:]
    starts -= starts[0]
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return np.add.reduceat(np.where(inside, values * POWERS[place & 255], np.uint32(0)), starts, dtype=np.uint32)


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves no rest by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most ``sample`` labelled ids, the first by hash. Of several labels of an id the largest counts."""
    few = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def fit(rows: DataFrame, cost: float = 1.0, epochs: int = 20) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, offset) from rows (doc_id, features as packed int32, y).

    Four fifths of the rows give the log-count ratios and the support vectors; the last fifth turns margins into probabilities.
    """

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        x = [np.frombuffer(b, np.int32) for b in part["features"]]
        y = np.where(part["y"].to_numpy() > 0, 1.0, -1.0)
        order = np.random.default_rng(7).permutation(len(y))
        learn, check = (order, order) if len(order) < 50 else (order[len(order) // 5:], order[: len(order) // 5])
        counts = np.ones((2, SIZE))
        for i in learn:
            counts[int(y[i] > 0), x[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        values = [ratio[v] for v in x]
        norms = [max(np.sqrt(v @ v), 1e-9) for v in values]
        values = [v / n for v, n in zip(values, norms)]
        w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
        squares = np.array([v @ v + 1 for v in values])
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            moved = 0.0
            for i in rng.permutation(learn):
                slope = y[i] * (w[x[i]] @ values[i] + bias) - 1
                step = min(max(alpha[i] - slope / squares[i], 0.0), cost) - alpha[i]
                if step:
                    alpha[i] += step
                    w[x[i]] += step * y[i] * values[i]
                    bias += step * y[i]
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        margins = np.array([w[x[i]] @ values[i] + bias for i in check]) if len(check) else np.zeros(0)
        a, b = _platt(margins, y[check] > 0)
        return pd.DataFrame({"weights": [(w).astype("<f4").tobytes()], "ratio": [ratio.astype("<f4").tobytes()], "bias": [bias], "a": [a], "b": [b]})

    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(train, "weights binary, ratio binary, bias double, a double, b double").first()
    if got is None:
        return np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), 0.0, 1.0, 0.0
    return np.frombuffer(got.weights, "<f4"), np.frombuffer(got.ratio, "<f4"), got.bias, got.a, got.b


def _platt(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Logistic scale of margins, with targets a little inside 0 and 1, by Newton steps."""
    ups, downs = positive.sum(), (~positive).sum()
    goal = np.where(positive, (ups + 1) / (ups + 2), 1 / (downs + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        e, h = p - goal, p * (1 - p)
        g = np.array([e @ margins + 1e-3 * (a - 1), e.sum() + 1e-3 * b])
        H = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(H, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def score(docs: DataFrame, keep: list[str], model) -> DataFrame:
    """``keep`` and ``score``, the probability of label 1."""
    weights, ratio, bias, a, b = model
    scaled, squares = weights * ratio, ratio.astype(np.float64) ** 2

    def make():
        indicators = Indicators()

        def compute(texts):
            out = []
            for text in texts:
                found = indicators(text)
                norm = np.sqrt(squares[found].sum()) or 1.0
                margin = float(scaled[found].sum(dtype=np.float64)) / max(norm, 1e-9) + bias
                out.append(float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))))
            return [out]

        return compute

    return map_texts(docs, keep, "text", [("score", "double")], make)


def features(rows: DataFrame) -> DataFrame:
    def make():
        indicators = Indicators()
        return lambda texts: [[indicators(t).tobytes() for t in texts]]

    return map_texts(rows, ["doc_id", "y"], "text", [("features", "binary")], make).dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE):
    """The model of rows whose id is not held out. Without such rows every text gets the score one half."""
    return fit(features(labelled(docs, labels.where(~held_out()), label, sample)))


@query("op4_quality")
def op4_quality(spark, folder):
    """doc_id, held_out, score and predicted of every document. Null texts are scored as empty; equal rows are all returned."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    return score(docs, ["doc_id"], model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
