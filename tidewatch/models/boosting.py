"""Boosted trees on histograms for any number of classes in one fit, and their form for raw categories.

Features are cut into bins once. Each level of a round's trees takes one aggregation: every task adds up first and second
derivatives of its rows per open node, feature and bin, and the driver picks the splits from the sums. What the driver and the tasks hold depends on
nodes, features, bins and classes, never on rows. Derivatives are rounded to a fixed fraction and added as integers, so the same
rows give the same trees in any order and any number of partitions.

A binned table of up to ``LOCAL_BYTES`` goes to one task, which takes all rounds without a job for each level; its features are shared by as many threads as an
executor has cores, and only the smaller child of a node is added up. Both ways give the same trees.
"""

from __future__ import annotations

import json
import math
import pickle
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.prefix import in_ranges, running_totals
from tidewatch.session import cut_lineage, executor_cores

# Settings of the run with raw categories.
ROUNDS, DEPTH, RATE = 500, 8, 0.1
BINS = 64
#: Derivatives and losses are rounded to this fraction.
UNIT = 1 << 20
#: Rounds whose trees are applied on the fly before the scores of all rows are stored again.
STORED_EVERY = 10
#: Rows x features that are worth a task of their own: every task returns sums of the same size.
CELLS = 1 << 20
#: What a task that takes all rounds may hold: per row a byte for each feature, its scores with their derivatives, and its place.
LOCAL_BYTES = 640 << 20
#: Sums of all tasks that the driver may add itself; beyond it they are added in Spark first.
DRIVER_BYTES = 64 << 20


def _mixed(values: np.ndarray, number: int) -> np.ndarray:
    """Even draws in [0, 1) from 64-bit hashes, another one for each number."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


class Trees:
    """The trees of one round in the layout of a complete tree: the children of node p are 2p + 1 and 2p + 2.

    ``feature`` is -1 in leaves; ``value`` holds what each node adds to the score of each class.
    """

    def __init__(self, trees: int, depth: int, scores: int):
        nodes = (1 << (depth + 1)) - 1
        self.depth = depth
        self.feature, self.bin = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32)
        self.value = np.zeros((trees, nodes, scores))

    def nodes(self, bins: np.ndarray, tree: int, levels: int | None = None) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            feature = self.feature[tree][at]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[tree][at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at

    def add_to(self, scores: np.ndarray, bins: np.ndarray) -> None:
        for t in range(len(self.feature)):
            scores += self.value[t][self.nodes(bins, t)]


def chances(scores: np.ndarray) -> np.ndarray:
    """Class chances: one score is the log odds of class 1, several are exponents."""
    if scores.shape[1] == 1:
        one = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
        return np.hstack([1 - one, one])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by each score, as integers of ``1 / UNIT``."""
    p = chances(scores)
    g = p - (np.arange(p.shape[1]) == y[:, None])
    h = p * (1 - p)
    if scores.shape[1] == 1:
        g, h = g[:, 1:], h[:, 1:]
    return np.rint(g * UNIT), np.rint(h * UNIT)


def best_splits(sums: np.ndarray, l2: float, least: float, shared: bool):
    """For sums (node, score, feature, bin, 2): the feature and the last bin that goes left, and the gain, of each node.

    With ``shared`` all nodes get one split, the one with the largest gain in total. Of equal gains the first feature and bin count.
    """
    return _best(_gains(sums, l2, least, shared), shared)


def _gains(sums: np.ndarray, l2: float, least: float, shared: bool) -> np.ndarray:
    """The gain (node, feature, bin) of each split; no feature has a say in another one's."""

    def part(g, h):
        return g**2 / (h + l2)

    g, h = (np.cumsum(np.ascontiguousarray(sums[..., d]), axis=3) / UNIT for d in (0, 1))
    left_g, left_h, total_g, total_h = g[..., :-1], h[..., :-1], g[..., -1:], h[..., -1:]
    right_g, right_h = total_g - left_g, total_h - left_h
    allowed = (left_h.sum(1) >= least) & (right_h.sum(1) >= least)
    gain = (part(left_g, left_h) + part(right_g, right_h) - part(total_g, total_h)).sum(axis=1)
    return np.where(allowed, gain, 0.0 if shared else -np.inf)


def _best(gain: np.ndarray, shared: bool):
    if shared:
        gain = np.broadcast_to(gain.sum(axis=0), gain.shape)
    flat = np.round(gain, 9).reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(flat)), at]


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of rows of equal size as a matrix, without copying."""
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset:][: len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[starts[0]: starts[-1]].view(kind).reshape(len(column), width)


class HistogramBoosting:
    """Gradient boosting by second-order steps on ``features`` and ``label`` (0, 1, ...).

    A round has one tree per class (one for two classes), or with ``symmetric`` one tree for all, whose nodes of a level share one
    split. ``rows`` and ``columns`` are the shares that a round draws, by hash. Rows marked in the boolean column ``validation`` take no part in
    any sum; the model keeps as many rounds as give them the least loss, and stops early when ``patience`` rounds brought no better one.
    Missing values count as the largest ones. Label null is left out.
    """

    def __init__(self, classes: int = 2, rounds: int = 200, depth: int = 7, rate: float = RATE, bins: int = BINS, l2: float = 1.0, least: float = 1.0,
                 rows: float = 1.0, columns: float = 1.0, symmetric: bool = False, validation: str | None = None, patience: int | None = None, seed: int = 42):
        if not 2 <= bins <= 255:
            raise ValueError("2 to 255 bins")
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = classes, rounds, depth, rate, bins, l2, least
        self.rows, self.columns, self.symmetric, self.validation, self.patience, self.seed = rows, columns, symmetric, validation, patience, seed

    def fit(self, df: DataFrame) -> "BoostingModel":
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        return self._fit(df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), held.alias("held")))

    def _fit(self, rows: DataFrame) -> "BoostingModel":
        rows = cut_lineage(rows.where("y IS NOT NULL"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no labelled rows")
        width = first[0]
        edges = self._edges(rows, width)
        counts = {r.y: r.n for r in rows.where("NOT held").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = np.array([counts.get(c, 0) + 1.0 for c in range(self.classes)])
        start = np.log(share[1:] / share[:1]) if self.classes == 2 else np.log(share / share.sum())
        self.scores = len(start)
        total = rows.count()
        binned_rows = self._binned(rows, edges, start)
        if total * (width + 64 + 48 * self.scores) <= LOCAL_BYTES:
            found, history = self._alone(cut_lineage(binned_rows), total, width)
            return BoostingModel(edges, start, found, self.classes, history)
        tasks = max(1, math.ceil(total * width / CELLS))
        by_levels = _ByLevels(self, self._stored(binned_rows.coalesce(tasks), [], width), width)
        try:
            found, history = self._rounds(by_levels)
        finally:
            by_levels.state.unpersist()
        return BoostingModel(edges, start, found, self.classes, history)

    def _rounds(self, grower) -> tuple[list[Trees], list[tuple]]:
        """The trees of the rounds kept, and the history; ``grower`` gives the trees of a round and how the model did before it, and adds them to the scores."""
        model, best = BoostingModel([], np.zeros(self.scores), [], self.classes, []), None
        for number in range(self.rounds):
            trees, seen = grower.grow(number)
            best = self._judge(model, seen, best)
            if best is not None and self.patience is not None and number - best[1] >= self.patience:
                break
            model.rounds.append(trees)
            grower.add(trees)
        if len(model.history) == len(model.rounds):
            best = self._judge(model, grower.seen(), best)
        return model.rounds if best is None else model.rounds[: best[1]], model.history

    def _alone(self, state: DataFrame, total: int, width: int) -> tuple[list[Trees], list[tuple]]:
        """All rounds in one task."""
        threads, settings = executor_cores(state.sparkSession), self

        def run(batches):
            grower = _Alone(settings, total, width, threads)
            for batch in batches:
                grower.read(batch)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(settings._rounds(grower))], pa.binary())], ["model"])

        return pickle.loads(state.coalesce(1).mapInArrow(run, "model binary").toArrow().column("model")[0].as_py())

    def _judge(self, model, seen, best):
        """Notes loss and accuracy after the rounds so far; returns the least loss on the held-out rows and its number of rounds."""
        loss, n, right, held_loss, held_n, held_right = seen.tolist()
        share = lambda a, b: a / b if b else None
        model.history.append((len(model.history), share(loss / UNIT, n), share(right, n), share(held_loss / UNIT, held_n), share(held_right, held_n)))
        if not self.validation or not held_n:
            return None
        return (held_loss, len(model.history) - 1) if best is None or held_loss < best[0] else best

    def _edges(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Upper ends of the bins of each feature: quantiles of all training values, without the largest."""
        at = ", ".join(repr(i / self.bins) for i in range(1, self.bins))
        found = rows.where("NOT held").select(*[F.expr(f"percentile_approx(IF(isnan(x[{i}]), NULL, x[{i}]), array({at}), 10000)").alias(f"f{i}") for i in range(width)]).first()
        return [np.unique(np.array(found[i] or [], float)) for i in range(width)]

    def _binned(self, rows: DataFrame, edges: list[np.ndarray], start: np.ndarray) -> DataFrame:
        """(bins, y, held, draw, scores): a byte per feature, and a hash of the content that says when the row is drawn."""
        first = start.astype("<f8").tobytes()

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                packed = binned(_values(batch.column("x"), len(edges)), edges)
                out = [pa.array([r.tobytes() for r in packed], pa.binary()), batch.column("y"), batch.column("held"), batch.column("draw"), pa.array([first] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["bins", "y", "held", "draw", "scores"])

        draw = rows.withColumn("draw", F.xxhash64("x", "y", F.lit(self.seed)))
        return draw.mapInArrow(run, "bins binary, y int, held boolean, draw long, scores binary")

    def _stored(self, state: DataFrame, recent: list[Trees], width: int) -> DataFrame:
        """The rows with the scores that the trees so far give, as a stored table kept at hand."""

        def run(batches):
            for batch in batches:
                bins, scores = _matrix(batch.column("bins"), np.uint8, width), _matrix(batch.column("scores"), "<f8", self.scores).copy()
                for trees in recent:
                    trees.add_to(scores, bins)
                columns = [batch.column(c) for c in ("bins", "y", "held", "draw")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in scores], pa.binary())], ["bins", "y", "held", "draw", "scores"])

        if recent:
            state = state.mapInArrow(run, "bins binary, y int, held boolean, draw long, scores binary")
        return cut_lineage(state).persist()

    def _grow(self, state: DataFrame, recent: list[Trees], width: int, number: int) -> tuple[Trees, np.ndarray]:
        """The trees of a round, and how the model did before it."""
        count = 1 if self.symmetric else self.scores
        trees, seen = Trees(count, self.depth, self.scores), None
        chosen = self._chosen(width, number)
        open_ = [(t, 0) for t in range(count)]
        for level in range(self.depth):
            if not open_:
                break
            slots, sums, told = self._sums(state, recent, trees, open_, chosen, width, number)
            seen = told if level == 0 else seen
            if not len(slots):
                break
            if level == 0:
                for (t, p), s in zip(slots, sums):
                    self._value(trees, t, p, s[:, 0].sum(axis=1))
            feature, last, gain = best_splits(sums, self.l2, self.least, self.symmetric)
            open_ = []
            for i, (t, p) in enumerate(slots):
                if not gain[i] > 1e-9:
                    continue
                f, b = int(feature[i]), int(last[i])
                trees.feature[t, p], trees.bin[t, p] = chosen[f], b
                left = sums[i][:, f, : b + 1].sum(axis=1)
                for child, s in ((2 * p + 1, left), (2 * p + 2, sums[i][:, f].sum(axis=1) - left)):
                    self._value(trees, t, child, s)
                    open_.append((t, child))
        return trees, seen

    def _chosen(self, width: int, number: int) -> np.ndarray:
        """The features that a round draws."""
        if self.columns < 1:
            return np.sort(np.random.default_rng([self.seed, number]).permutation(width)[: max(1, math.ceil(self.columns * width))])
        return np.arange(width)

    def _value(self, trees: Trees, t: int, node: int, sums: np.ndarray) -> None:
        step = -self.rate * sums[:, 0] / (sums[:, 1] + self.l2 * UNIT)
        if self.symmetric:
            trees.value[t, node] = step
        else:
            trees.value[t, node, t] = step[0]

    def _sums(self, state: DataFrame, recent: list[Trees], trees: Trees | None, open_: list[tuple[int, int]], chosen: np.ndarray, width: int, number: int):
        """The open nodes that hold rows, their sums (score, feature, bin, 2), and loss, rows and right answers of training and held-out rows."""
        per, bins_n, k = (self.scores if self.symmetric else 1), self.bins, self.scores
        level = int(math.log2(open_[0][1] + 1)) if open_ else 0
        place: dict[int, np.ndarray] = {}
        for i, (t, p) in enumerate(open_):
            place.setdefault(t, np.full(0 if trees is None else trees.feature.shape[1], -1, np.int64))[p] = i
        shape = (len(open_), per, len(chosen), bins_n, 2)
        symmetric, drawn = self.symmetric, self.rows

        def run(batches):
            sums, seen = np.zeros(shape), np.zeros(6, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, scores = _matrix(batch.column("bins"), np.uint8, width), _matrix(batch.column("scores"), "<f8", k).copy()
                y, held = batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
                for earlier in recent:
                    earlier.add_to(scores, bins)
                if level == 0:
                    seen += _seen(scores, y, held)
                used = ~held
                if drawn < 1:
                    used &= _mixed(batch.column("draw").to_numpy(), number) < drawn
                g, h = derivatives(scores[used], y[used])
                bins = bins[used]
                for t, slots in place.items():
                    slot = slots[trees.nodes(bins, t, level)]
                    here = slot >= 0
                    base, cells = slot[here] * bins_n, len(open_) * bins_n
                    for j, f in enumerate(chosen):
                        index = base + bins[here, f]
                        for s in range(per):
                            c = s if symmetric else t
                            for d, values in enumerate((g, h)):
                                sums[:, s, j, :, d] += np.bincount(index, values[here, c], cells).reshape(-1, bins_n)
            filled = [i for i in range(len(open_)) if sums[i, :, 0, :, 1].any()]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *filled], pa.int32()), pa.array([seen.tobytes(), *(sums[i].astype(np.int64).tobytes() for i in filled)], pa.binary())], ["slot", "sums"])

        parts = state.mapInArrow(run, "slot int, sums binary")
        tasks = state.rdd.getNumPartitions()
        if tasks * int(np.prod(shape)) * 8 > DRIVER_BYTES:
            parts = _added(_added(parts.withColumn("pack", F.pmod(F.spark_partition_id(), F.lit(math.ceil(math.sqrt(tasks))))), "pack"))
        found, told = {}, np.zeros(6, np.int64)
        table = parts.toArrow()
        for slot, value in zip(table.column("slot").to_pylist(), table.column("sums")):
            values = np.frombuffer(value.as_buffer(), np.int64)
            if slot < 0:
                told = told + values
            else:
                found[slot] = found[slot] + values if slot in found else values
        order = sorted(found)
        return [open_[i] for i in order], np.array([found[i].reshape(shape[1:]) for i in order], float).reshape(len(order), *shape[1:]), told


def _seen(scores: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Loss, rows and right answers of training and held-out rows."""
    p, seen = chances(scores), np.zeros(6, np.int64)
    loss = np.rint(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * UNIT).astype(np.int64)
    right = p.argmax(axis=1) == y
    for at, mine in ((0, ~held), (3, held)):
        seen[at: at + 3] = loss[mine].sum(), mine.sum(), right[mine].sum()
    return seen


class _ByLevels:
    """Rounds with a job for each level; the scores are stored again every few rounds."""

    def __init__(self, settings: HistogramBoosting, state: DataFrame, width: int):
        self.settings, self.state, self.width, self.recent = settings, state, width, []

    def grow(self, number: int) -> tuple[Trees, np.ndarray]:
        return self.settings._grow(self.state, self.recent, self.width, number)

    def add(self, trees: Trees) -> None:
        self.recent.append(trees)
        if len(self.recent) == STORED_EVERY:
            self.state, self.recent, old = self.settings._stored(self.state, self.recent, self.width), [], self.state
            old.unpersist()

    def seen(self) -> np.ndarray:
        return self.settings._sums(self.state, self.recent, None, [], np.arange(self.width), self.width, 0)[2]


class _Alone:
    """Rounds by one task that holds all rows, feature by feature."""

    def __init__(self, settings: HistogramBoosting, total: int, width: int, threads: int):
        self.settings, self.total, self.width, self.rows = settings, total, width, 0
        self.pool, self.threads = ThreadPoolExecutor(threads), threads
        self.bins, self.scores = np.zeros((width, total), np.uint8), np.zeros((total, settings.scores))
        self.y, self.held, self.draw = np.zeros(total, np.int32), np.zeros(total, bool), np.zeros(total, np.int64)

    def read(self, batch: pa.RecordBatch) -> None:
        at = slice(self.rows, self.rows + batch.num_rows)
        self.bins[:, at] = _matrix(batch.column("bins"), np.uint8, self.width).T
        self.scores[at] = _matrix(batch.column("scores"), "<f8", self.settings.scores)
        self.y[at], self.draw[at] = batch.column("y").to_numpy(), batch.column("draw").to_numpy()
        self.held[at] = batch.column("held").to_numpy(zero_copy_only=False)
        self.rows = at.stop

    def _pieces(self, run) -> list:
        """``run`` for consecutive pieces of the rows, by all threads."""
        ends = np.linspace(0, self.total, self.threads * 4 + 1).astype(int)
        return list(self.pool.map(lambda at: run(slice(*at)), zip(ends, ends[1:])))

    def seen(self) -> np.ndarray:
        return sum(self._pieces(lambda at: _seen(self.scores[at], self.y[at], self.held[at])))

    def add(self, trees: Trees) -> None:
        def run(at: slice) -> None:
            bins, rows = self.bins[:, at], np.arange(at.stop - at.start)
            for t in range(len(trees.feature)):
                node = np.zeros(len(rows), np.int64)
                for _ in range(trees.depth):
                    feature = trees.feature[t][node]
                    right = bins[np.maximum(feature, 0), rows] > trees.bin[t][node]
                    node = np.where(feature >= 0, 2 * node + 1 + right, node)
                self.scores[at] += trees.value[t][node]

        self._pieces(run)

    def grow(self, number: int) -> tuple[Trees, np.ndarray]:
        settings, seen = self.settings, self.seen()
        used = ~self.held
        if settings.rows < 1:
            used &= _mixed(self.draw, number) < settings.rows
        used = np.flatnonzero(used)
        g, h = derivatives(self.scores[used], self.y[used])
        chosen, count = settings._chosen(self.width, number), 1 if settings.symmetric else settings.scores
        trees = Trees(count, settings.depth, settings.scores)
        for t in range(count):
            mine = slice(None) if settings.symmetric else slice(t, t + 1)
            self._tree(trees, t, used, np.ascontiguousarray(g[:, mine].T), np.ascontiguousarray(h[:, mine].T), chosen)
        return trees, seen

    def _tree(self, trees: Trees, t: int, used: np.ndarray, g: np.ndarray, h: np.ndarray, chosen: np.ndarray) -> None:
        """One tree. A level's rows (places in ``used``) lie node by node."""
        settings = self.settings
        rows, sizes, places = np.arange(len(used)), np.array([len(used)]), [0]
        sums = self._sums(used, g, h, rows, sizes, chosen)
        for level in range(settings.depth):
            filled = sums[:, :, 0, :, 1].any(axis=(1, 2))
            rows, sizes, sums, places = rows[np.repeat(filled, sizes)], sizes[filled], sums[filled], [p for p, f in zip(places, filled) if f]
            if not places:
                return
            if level == 0:
                settings._value(trees, t, 0, sums[0][:, 0].sum(axis=1))
            feature, last, gain = _best(self._gains(sums), settings.symmetric)
            split = gain > 1e-9
            for i in np.flatnonzero(split):
                f, b, p = int(feature[i]), int(last[i]), places[i]
                trees.feature[t, p], trees.bin[t, p] = chosen[f], b
                left = sums[i][:, f, : b + 1].sum(axis=1)
                settings._value(trees, t, 2 * p + 1, left)
                settings._value(trees, t, 2 * p + 2, sums[i][:, f].sum(axis=1) - left)
            if level == settings.depth - 1 or not split.any():
                return
            rows, sizes, parents, places = rows[np.repeat(split, sizes)], sizes[split], sums[split], [p for p, s in zip(places, split) if s]
            right = self.bins[np.repeat(chosen[feature[split]], sizes), used[rows]] > np.repeat(last[split], sizes)
            child = np.repeat(2 * np.arange(len(places)), sizes) + right
            rows = rows[np.argsort(child.astype(np.uint16), kind="stable")]
            sizes = np.bincount(child, minlength=2 * len(places))
            # The smaller child of each node is added up; the other one is what is left of the node.
            smaller = sizes[1::2] < sizes[::2]
            wanted = np.stack([~smaller, smaller], axis=1).ravel()
            own = self._sums(used, g, h, rows[np.repeat(wanted, sizes)], sizes[wanted], chosen)
            sums = np.empty((2 * len(places), *own.shape[1:]))
            sums[wanted], sums[~wanted] = own, parents - own
            places = [c for p in places for c in (2 * p + 1, 2 * p + 2)]

    def _gains(self, sums: np.ndarray) -> np.ndarray:
        """As the function, a few features in each thread."""
        settings = self.settings
        ends = np.linspace(0, sums.shape[2], min(self.threads, sums.shape[2]) + 1).astype(int)
        return np.concatenate(list(self.pool.map(
            lambda at: _gains(sums[:, :, at[0]: at[1]], settings.l2, settings.least, settings.symmetric), zip(ends, ends[1:]))), axis=1)

    def _sums(self, used: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Sums (node, score, feature, bin, 2) of rows that lie node by node."""
        bins_n, at = self.settings.bins, used[rows]
        sums = np.zeros((len(sizes), len(g), len(chosen), bins_n, 2))
        base, values = np.repeat(np.arange(len(sizes)) * bins_n, sizes), [(s, d, v[s][rows]) for s in range(len(g)) for d, v in enumerate((g, h))]

        def run(t: int) -> None:
            bins, index = np.empty(len(at), np.uint8), np.empty(len(at), np.int64)  # once a thread: new memory for each feature would cost more than the sums
            for j in range(t, len(chosen), self.threads):
                np.take(self.bins[chosen[j]], at, out=bins, mode="clip")
                np.add(base, bins, out=index)
                for s, d, v in values:
                    sums[:, s, j, :, d] = np.bincount(index, v, len(sizes) * bins_n).reshape(-1, bins_n)

        list(self.pool.map(run, range(self.threads)))
        return sums


def _added(parts: DataFrame, *more: str) -> DataFrame:
    """Packed sums added up by slot."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(v, np.int64) for v in rows["sums"]))
        return pd.DataFrame({"slot": [rows["slot"].iloc[0]], "sums": [total.tobytes()]})

    return parts.groupBy("slot", *more).applyInPandas(add, "slot int, sums binary")


def _values(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many ends lie below it. Missing values come last."""
    out = np.zeros(x.shape, np.uint8)
    for i, ends in enumerate(edges):
        out[:, i] = np.searchsorted(ends, x[:, i], side="left")
    return out


class BoostingModel:
    """Ends of the bins, starting scores and the trees of each round. ``history`` has a row (rounds, loss, accuracy, val_loss, val_accuracy) per step."""

    def __init__(self, edges: list[np.ndarray], start: np.ndarray, rounds: list[Trees], classes: int, history: list[tuple]):
        self.edges, self.start, self.rounds, self.classes, self.history = edges, start, rounds, classes, history
        self._shared = None

    def first(self, rounds: int) -> "BoostingModel":
        """The model as it was after this many rounds: draws depend on the round only, so a fit of that many gives the same one."""
        return BoostingModel(self.edges, self.start, self.rounds[:rounds], self.classes, self.history[:rounds])

    def trees_used(self) -> int:
        """Rounds kept."""
        return len(self.rounds)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, bins = np.tile(self.start, (len(x), 1)), binned(x, self.edges)
        for trees in self.rounds:
            trees.add_to(out, bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transform_array(df, vector_to_array("features"))

    def transform_array(self, df: DataFrame, x: Column) -> DataFrame:
        """Adds probability and prediction by the features in an array column."""
        if self._shared is None:
            plain = BoostingModel(self.edges, self.start, self.rounds, self.classes, [])
            self._shared = df.sparkSession.sparkContext.broadcast(plain)
        shared, width = self._shared, len(self.edges)

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            found = np.array(features.tolist(), dtype=float).reshape(len(features), width)
            return pd.Series(list(chances(shared.value.scores(found))))

        scored = df.withColumn("__p", probabilities(x))
        best = F.array_position("__p", F.array_max("__p")).cast("double") - 1
        return scored.withColumns({"probability": array_to_vector("__p"), "prediction": best}).drop("__p")

    def __getstate__(self):
        return self.__dict__ | {"_shared": None}

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t.depth, t.feature.tolist(), t.bin.tolist(), t.value.tolist()) for i, t in enumerate(self.rounds)]
        spark.createDataFrame(rows, "round int, depth int, feature array<array<int>>, bin array<array<int>>, value array<array<array<double>>>").write.mode(
            "overwrite").parquet(f"{path}/rounds")
        info = json.dumps({"edges": [e.tolist() for e in self.edges], "start": self.start.tolist(), "classes": self.classes, "history": self.history})
        spark.createDataFrame([(info,)], "info string").write.mode("overwrite").parquet(f"{path}/info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostingModel":
        info = json.loads(spark.read.parquet(f"{path}/info").first().info)
        rounds = []
        for r in spark.read.parquet(f"{path}/rounds").orderBy("round").collect():
            value = np.array(r["value"], float)
            trees = Trees(len(r["feature"]), r["depth"], value.shape[2])
            trees.feature, trees.bin, trees.value = np.array(r["feature"], np.int32), np.array(r["bin"], np.int32), value
            rounds.append(trees)
        return cls([np.array(e, float) for e in info["edges"]], np.array(info["start"], float), rounds, info["classes"], [tuple(h) for h in info["history"]])


class CategoryBoosting:
    """Boosting on numbers and raw categories: ordered category shares, then symmetric trees.

    A training row's category is replaced, per class, by the share of the class among the training rows of that category that come *before* it in
    an order by hash of its key, so no row sees its own label. Other rows see all training rows. ``smoothing`` rows with the overall share are added, so
    an unseen category gets that share. Categories are found by a join, so there may be any number of them. ``key`` must be unique.
    """

    def __init__(self, classes: int, numbers: list[str], categories: list[str], key: str = "key", rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
                 validation: str | None = None, patience: int | None = None, smoothing: float = 1.0, bins: int = BINS, l2: float = 3.0, seed: int = 42):
        self.numbers, self.categories, self.key, self.classes, self.smoothing, self.seed = numbers, categories, key, classes, smoothing, seed
        self.validation = validation
        self.boosting = HistogramBoosting(classes, rounds, depth, rate, bins, l2, symmetric=True, validation="held" if validation else None, patience=patience, seed=seed)

    def fit(self, df: DataFrame) -> "CategoryBoostingModel":
        targets = [1] if self.classes == 2 else list(range(self.classes))
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        rows = df.where("label IS NOT NULL").select(
            F.col(self.key).alias("__key"), F.col("label").cast("int").alias("__y"), held.alias("__held"),
            *[F.col(c).cast("double").alias(c) for c in self.numbers], *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in self.categories],
            *[(F.col("label") == t).cast("long").alias(f"__is{t}") for t in targets], F.lit(1).cast("long").alias("__n"))
        rows = cut_lineage(rows)
        train = rows.where("NOT __held")
        seen = train.agg(*[F.avg(f"__is{t}").alias(f"p{t}") for t in targets]).first()
        priors = {t: seen[f"p{t}"] or 0.0 for t in targets}
        model = CategoryBoostingModel(self, priors, {c: cut_lineage(train.groupBy(c).agg(*[F.sum(f"__is{t}").alias(f"{c}__is{t}") for t in targets], F.sum("__n").alias(f"{c}__n")))
                                                     for c in self.categories})
        ordered = train.withColumn("__order", F.concat(F.md5(F.concat_ws(":", F.lit(self.seed), F.col("__key").cast("string"))), F.col("__key").cast("string")))
        ordered = ranges = in_ranges(ordered, "__order")  # once for all categories
        for c in self.categories:
            ordered = running_totals(ordered, [c], "__order", [*(f"__is{t}" for t in targets), "__n"], ranges=ranges)
            ordered = ordered.withColumns({f"{c}__is{t}": F.col(f"__is{t}_before") for t in targets} | {f"{c}__n": F.col("__n_before")})
            ordered = ordered.drop(*[f"__is{t}_before" for t in targets], "__n_before")
        shown = model.features(ordered, known=True).select("x", F.col("__y").alias("y"), F.col("__held").alias("held"))
        if self.validation:
            shown = shown.unionByName(model.features(rows.where("__held")).select("x", F.col("__y").alias("y"), F.col("__held").alias("held")))
        model.trees = self.boosting._fit(shown)
        return model


class CategoryBoostingModel:
    def __init__(self, settings: CategoryBoosting, priors: dict[int, float], totals: dict[str, DataFrame], trees: BoostingModel | None = None):
        self.numbers, self.categories, self.smoothing, self.priors, self.totals, self.trees = (
            settings.numbers, settings.categories, settings.smoothing, priors, totals, trees)

    def features(self, df: DataFrame, known: bool = False) -> DataFrame:
        """Adds ``x``: the numbers, then per category the share of each class; counts are joined unless they are ``known`` already."""
        out = df
        if not known:
            for c in self.categories:
                out = out.join(self.totals[c].withColumnRenamed(c, f"{c}__value"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) == F.col(f"{c}__value"), "left").drop(f"{c}__value")
        shares = [(F.coalesce(F.col(f"{c}__is{t}"), F.lit(0)) + self.smoothing * p) / (F.coalesce(F.col(f"{c}__n"), F.lit(0)) + self.smoothing)
                  for c in self.categories for t, p in self.priors.items()]
        x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in self.numbers], *[s.cast("double") for s in shares])
        return out.withColumn("x", x).drop(*[f"{c}__{s}" for c in self.categories for s in ("n", *(f"is{t}" for t in self.priors))])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.transform_array(self.features(df), F.col("x")).drop("x")

    def trees_used(self) -> int:
        return self.trees.trees_used()

    def save(self, spark: SparkSession, path: str) -> None:
        self.trees.save(spark, path)
        for i, c in enumerate(self.categories):
            self.totals[c].write.mode("overwrite").parquet(f"{path}/category_{i}")
        info = json.dumps({"numbers": self.numbers, "categories": self.categories, "smoothing": self.smoothing, "priors": list(self.priors.items())})
        spark.createDataFrame([(info,)], "info string").write.mode("overwrite").parquet(f"{path}/categories")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategoryBoostingModel":
        info = json.loads(spark.read.parquet(f"{path}/categories").first().info)
        settings = CategoryBoosting(2, info["numbers"], info["categories"], smoothing=info["smoothing"])
        totals = {c: spark.read.parquet(f"{path}/category_{i}") for i, c in enumerate(info["categories"])}
        return cls(settings, dict(map(tuple, info["priors"])), totals, BoostingModel.load(spark, path))
