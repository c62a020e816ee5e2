"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts, text_blocks
from tidewatch.llm.quality import labelled
from tidewatch.llm.registry import query, table

#: Categories before the labelled one: a toxic document belongs to each whose words it holds (fixed values).
CATEGORIES = {
    "insult": ["idiot", "moron", "loser", "clown", "stupid"],
    "contempt": ["scum", "trash", "worthless", "pathetic", "disgusting"],
}
#: Bounds of the fit: labelled rows, chosen terms, and the least number of documents that hold a term.
SAMPLE, TERMS, LEAST, FOLDS = 12_000, 1024, 3, 3
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    """Distinct words in small letters, and the first letters of longer words (``lowe*``) for compounds."""
    words: set[str] = set()
    for block in text_blocks(text or ""):
        words.update(_WORD.findall(block.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def vocabulary(rows: DataFrame, size: int = TERMS) -> list[str]:
    """The terms with the largest chi-square by label over all ``rows`` (text, y)."""
    held = map_texts(rows, ["doc_id", "y"], "text", [("terms", "array<string>")], lambda: lambda texts: [[list(terms(t)) for t in texts]])
    held = held.dropDuplicates(["doc_id"])
    totals = held.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    n, n1 = totals.n or 0, totals.n1 or 0
    if not 0 < n1 < n:
        return []
    a, d = F.col("a"), F.col("d")
    chi = (F.lit(float(n)) * F.pow(a * (n - n1) - (d - a) * n1, 2)) / (d * (n - d) * float(n1) * float(n - n1))
    counts = held.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("d"))
    best = counts.where((d >= LEAST) & (d < n)).select("term", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(size)
    return [r.term for r in best.collect()]


class Sparse:
    """Rows of 0/1 terms by their numbers, with a few dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], size: int, beside: np.ndarray | None = None):
        self.rows, self.size = rows, size
        self.terms = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.lengths)])
        self.beside = np.zeros((len(rows), 0)) if beside is None else beside

    def __getitem__(self, chosen: np.ndarray) -> "Sparse":
        return Sparse([self.rows[i] for i in np.flatnonzero(chosen)], self.size, self.beside[chosen])

    def with_column(self, values: np.ndarray) -> "Sparse":
        return Sparse(self.rows, self.size, np.column_stack([self.beside, values]))

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.terms])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]] + self.beside @ w[self.size:-1] + w[-1]

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.terms, np.repeat(errors, self.lengths), self.size), errors @ self.beside, [errors.sum()]])

    def chances(self, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.times(w), -30, 30)))


def _fit_logistic(x: Sparse, y: np.ndarray, ridge: float = 1e-5, rounds: int = 600) -> np.ndarray:
    """Weights of the terms, the columns beside them and last the intercept, by accelerated gradient steps."""
    n = max(len(y), 1)
    w = np.zeros(x.size + x.beside.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    scale = 4.0 / (x.lengths.mean() + (x.beside**2).sum(1).mean() + 1) if len(y) else 0.0
    inner = np.arange(len(w)) < len(w) - 1
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        step = ahead - scale * (x.back(x.chances(ahead) - y) / n + ridge * ahead * inner)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = step + (old - 1) / t * (step - w), step
    return w


def fit_chain(x: Sparse, targets: np.ndarray, folds: int = FOLDS) -> tuple[list[np.ndarray], float]:
    """One weight vector per category, and the threshold for the last one.

    A category's training column for the models after it is predicted out of fold, so that those models see chances as uncertain
    as they will be on new texts. The threshold has the best F1 out of fold, the middle one among equals.
    """
    n = len(targets)
    fold = np.random.default_rng(3).permutation(n) % folds
    weights, chances = [], np.zeros(n)
    for k in range(targets.shape[1]):
        y, chances = targets[:, k].astype(np.float64), np.zeros(n)
        for f in range(folds):
            chances[fold == f] = x[fold == f].chances(_fit_logistic(x[fold != f], y[fold != f]))
        weights.append(_fit_logistic(x, y))
        x = x.with_column(chances)
    levels = np.linspace(0.2, 0.8, 25)
    f1 = np.array([2 * ((chances >= t) & (y > 0)).sum() / max(((chances >= t).sum() + (y > 0).sum()), 1) for t in levels])
    best = levels[f1 >= f1.max() - 1e-9]
    return weights, float(best[len(best) // 2])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories=CATEGORIES, sample: int = SAMPLE):
    """(terms, category names, weights, threshold) from at most ``sample`` labelled documents. None without both labels."""
    rows = labelled(docs, labels, label, sample)
    chosen = vocabulary(rows)
    if not chosen:
        return None
    at, names = {t: i for i, t in enumerate(chosen)}, [*categories, label]
    lists = [frozenset(words) for words in categories.values()]

    def make():
        def compute(texts):
            held = [terms(t) for t in texts]
            found = [np.array(sorted(at[t] for t in h if t in at), "<i4").tobytes() for h in held]
            return [found, [[int(bool(words & h)) for words in lists] for h in held]]
        return compute

    prepared = map_texts(rows, ["doc_id", "y"], "text", [("found", "binary"), ("hits", "array<int>")], make).dropDuplicates(["doc_id"])

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        x = Sparse([np.frombuffer(b, "<i4") for b in part["found"]], len(chosen))
        y = part["y"].to_numpy()
        hits = np.array(part["hits"].tolist(), np.int64).reshape(len(part), len(lists))
        weights, threshold = fit_chain(x, np.column_stack([hits * (y > 0)[:, None], y > 0]))
        return pd.DataFrame({"weights": [w.astype("<f8").tobytes() for w in weights], "threshold": threshold, "k": range(len(weights))})

    got = prepared.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "weights binary, threshold double, k int").collect()
    got = sorted(got, key=lambda r: r.k)
    return chosen, names, [np.frombuffer(r.weights, "<f8") for r in got], got[0].threshold


def score(docs: DataFrame, keep: list[str], model, text: str = "text", prefix: str = "") -> DataFrame:
    """``keep``, a chance ``p_<category>`` for each category, and ``rejected``: the last chance reaches the threshold. New names start with ``prefix``.

    Null and empty texts hold no terms. Without a model (no labels of both kinds) nothing is rejected and chances are null.
    """
    if model is None:
        names = [*CATEGORIES, "toxic"]
        return docs.select(*keep, *[F.lit(None).cast("double").alias(f"{prefix}p_{n}") for n in names], F.lit(False).alias(f"{prefix}rejected"))
    chosen, names, weights, threshold = model
    at, size = {t: i for i, t in enumerate(chosen)}, len(chosen)

    def make():
        def compute(texts):
            out = [[] for _ in names]
            for t in texts:
                found, before = [at[x] for x in terms(t) if x in at], []
                for k, w in enumerate(weights):
                    margin = w[found].sum() + (np.dot(w[size:-1], before) if before else 0.0) + w[-1]
                    before.append(float(1 / (1 + np.exp(-np.clip(margin, -30, 30)))))
                    out[k].append(before[-1])
            return [*out, [p >= threshold for p in out[-1]]]
        return compute

    return map_texts(docs, keep, text, [*[(f"{prefix}p_{n}", "double") for n in names], (f"{prefix}rejected", "boolean")], make)


@query("op9_toxicity")
def op9_toxicity(spark, folder):
    """doc_id, the chance of each category in the order of the chain, and toxic (0 or 1) of every document; equal rows are all returned."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    return score(docs, ["doc_id"], model).withColumn("toxic", F.col("rejected").cast("int")).drop("rejected")
