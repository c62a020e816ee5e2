"""Extremely randomised trees, grown level by level for all trees at once.

A row carries the place of the node it is in, for every tree (1 is the root, 2p and 2p + 1 the children of p). Two aggregations
per level: the value range of each candidate feature in each open node, from which the thresholds follow, and the class counts left
of each threshold. Tasks aggregate their own rows first and Spark merges the partial results; what a node draws is a hash of
the seed, the tree and its place, so the same rows give the same trees in any layout. Only the open nodes of a level are sent to the tasks,
wide levels in several rounds, so that what is sent and held stays small.

A table of up to ``LOCAL_VALUES`` numbers goes to the tasks whole, each number as its rank in its column, and every task grows trees of its own: they need nothing of
each other. Both ways give the same trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

SLOTS_PER_ROUND = 400_000  # (node, candidate) pairs whose statistics are held at once
LOCAL_VALUES = 20_000_000  # rows x features of a table that every task may hold
STORED_EVERY = 4  # levels whose splits are applied on the fly before the places are stored again


def _draws(seed: int, keys: np.ndarray, width: int) -> np.ndarray:
    """An even draw in [0, 1) for each node and feature."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x += np.uint64((seed * 0x2545F4914F6CDD1D + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _leaf(x: np.ndarray, tree: tuple) -> np.ndarray:
    """The counts of the leaf each row ends in."""
    feature, threshold, at, counts = tree
    inner = np.cumsum(feature >= 0) - 1  # the number of a node among those that have a threshold
    node, open_rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        here = node[open_rows]
        going = feature[here] >= 0
        open_rows, here = open_rows[going], here[going]
        if not len(open_rows):
            return counts[at[node]]
        node[open_rows] = at[here] + (x[open_rows, feature[here]] > threshold[inner[here]])


def _packed(place: np.ndarray, feature: np.ndarray, threshold: np.ndarray, counts: np.ndarray) -> tuple:
    """A tree as (feature or -1, thresholds of the inner nodes, left child or number of the leaf, rows of each class in each leaf).

    Nodes are numbered by place, so a right child follows its left one. A node that was split later replaces its entry as a leaf.
    """
    order = np.lexsort((feature < 0, place))
    place, feature = place[order], feature[order]
    first = np.concatenate([[True], place[1:] != place[:-1]])
    place, feature, order = place[first], feature[first], order[first]
    leaf = feature < 0
    at = np.where(leaf, np.cumsum(leaf) - 1, np.searchsorted(place, 2 * place))
    return feature.astype(np.int16), threshold[order][~leaf], at.astype(np.int32), counts[order][leaf].astype(np.int32)


class _Ranked:
    """A whole table for tasks that grow trees alone: per feature the sorted distinct values, and the rank of every row's value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int):
        self.rows, self.width, self.classes, self.y = len(x), x.shape[1], classes, y.astype(np.int32)
        self.known = [np.unique(x[:, f]) for f in range(self.width)]
        self.starts = np.cumsum([0, *(len(k) for k in self.known)])
        kind = np.uint16 if max(map(len, self.known)) <= 1 << 16 else np.uint32
        self.ranks = np.concatenate([np.searchsorted(k, x[:, f]).astype(kind) for f, k in enumerate(self.known)])

    def tree(self, tree: int, depth: int, seed: int, tried: int) -> tuple[tuple, np.ndarray]:
        """One tree, and what each feature took from the impurity. A level's rows lie node by node."""
        values, width = np.concatenate(self.known), self.width
        rows, keys, importance = np.arange(self.rows, dtype=np.int32), np.array([(tree << 32) | 1]), np.zeros(width)
        counts = np.bincount(self.y, minlength=self.classes)[None]
        nodes = [(keys, np.full(1, -1), np.zeros(1), counts)]
        for _ in range(depth):
            mixed = (counts > 0).sum(axis=1) > 1
            rows = rows[np.repeat(mixed, counts.sum(axis=1))]
            keys, counts = keys[mixed], counts[mixed]
            if not len(keys):
                break
            order = np.argsort(_draws(seed, keys, width), axis=1, kind="stable")
            chosen = order[:, :tried]
            low, high = self._ranges(rows, counts.sum(axis=1), chosen)
            stuck = np.flatnonzero(~(high > low).any(axis=1))
            if len(stuck) and width > tried:
                part = np.zeros(len(keys), bool)
                part[stuck] = True
                more_low, more_high = self._ranges(rows[np.repeat(part, counts.sum(axis=1))], counts[stuck].sum(axis=1), order[stuck])
                first = np.where((more_high > more_low).any(axis=1), (more_high > more_low).argmax(axis=1), 0) // tried * tried
                place = np.minimum(first[:, None] + np.arange(tried), width - 1)
                chosen[stuck] = np.take_along_axis(order[stuck], place, axis=1)
                low[stuck], high[stuck] = np.take_along_axis(more_low, place, axis=1), np.take_along_axis(more_high, place, axis=1)
            some = (high > low).any(axis=1)
            rows = rows[np.repeat(some, counts.sum(axis=1))]
            keys, counts, chosen, low, high = keys[some], counts[some], chosen[some], low[some], high[some]
            if not len(keys):
                break
            sizes = counts.sum(axis=1)
            least, most = values[self.starts[chosen] + low], values[self.starts[chosen] + high]
            thresholds = least + np.take_along_axis(_draws(seed + 1, keys, width), chosen, axis=1) * (most - least)
            thresholds = np.where(thresholds >= most, least, thresholds)  # never send every row left
            ends = np.zeros(chosen.shape, np.int64)  # ranks below it go left
            for f in np.unique(chosen):
                mine = chosen == f
                ends[mine] = np.searchsorted(self.known[f], thresholds[mine], side="right")
            cell = np.repeat(np.arange(len(keys)) * self.classes, sizes) + self.y[rows]
            left = np.empty((*chosen.shape, self.classes), np.int64)
            for s in range(tried):
                goes = self._of(rows, sizes, chosen[:, s]) < np.repeat(ends[:, s], sizes)
                left[:, s] = np.bincount(cell[goes], minlength=len(keys) * self.classes).reshape(-1, self.classes)
            impurity = np.where(high > low, _gini(left) + _gini(counts[:, None, :] - left), np.inf)
            best, at = impurity.argmin(axis=1), np.arange(len(keys))
            np.add.at(importance, chosen[at, best], _gini(counts) - impurity[at, best])
            nodes.append((keys, chosen[at, best], thresholds[at, best], counts))
            goes = self._of(rows, sizes, chosen[at, best]) < np.repeat(ends[at, best], sizes)
            rows = np.concatenate([rows[goes], rows[~goes]])
            place = keys & 0xFFFFFFFF
            keys = np.concatenate([(tree << 32) | (2 * place), (tree << 32) | (2 * place + 1)])
            counts = np.concatenate([left[at, best], counts - left[at, best]])
            nodes.append((keys, np.full(len(keys), -1), np.zeros(len(keys)), counts))
        keys, *rest = (np.concatenate(p) for p in zip(*nodes))
        return _packed(keys & 0xFFFFFFFF, *rest), importance

    def _of(self, rows: np.ndarray, sizes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The ranks of the rows of each node in the node's feature."""
        return self.ranks[np.repeat(features * self.rows, sizes) + rows]

    def _ranges(self, rows: np.ndarray, sizes: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.empty(candidates.shape, np.int64), np.empty(candidates.shape, np.int64)
        starts = np.cumsum(sizes) - sizes
        for s in range(candidates.shape[1]):
            values = self._of(rows, sizes, candidates[:, s])
            low[:, s], high[:, s] = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        return low, high


def _found(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are among the sorted ``known`` ones, and where."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    here = np.flatnonzero(known[at] == keys)
    return here, at[here]


def _gini(counts: np.ndarray) -> np.ndarray:
    """Impurity times rows, for the last axis."""
    total = counts.sum(-1)
    return total - (counts**2).sum(-1) / np.maximum(total, 1)


class _Rows:
    """What tasks do with the rows: read them, move them along the splits since they were stored, and add them up."""

    def __init__(self, trees: int, width: int, splits: list[tuple]):
        self.trees, self.width, self.splits = trees, width, splits

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, classes, and the key (tree, place) of each row and tree, rows by rows."""
        n = batch.num_rows
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, self.width)
        keys = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int64).copy()
        for known, feature, threshold in self.splits:
            here, at = _found(keys, known)
            right = x[here // self.trees, feature[at]] > threshold[at]
            tree, place = keys[here] >> 32, keys[here] & 0xFFFFFFFF
            keys[here] = (tree << 32) | (2 * place + right)
        return x, batch.column("y").to_numpy(), keys

    def stored(self, state: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                _, _, keys = self.read(batch)
                places = [r.tobytes() for r in keys.reshape(batch.num_rows, self.trees)]
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(places, pa.binary())], ["x", "y", "places"])

        return cut_lineage(state.mapInArrow(run, "x array<double>, y int, places binary"))

    def ranges(self, state: DataFrame, known: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest value of each candidate in each open node."""

        def run(batches):
            low, high = np.full(candidates.shape, np.inf), np.full(candidates.shape, -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, _, keys = self.read(batch)
                here, at = _found(keys, known)
                for s in range(candidates.shape[1]):
                    values = x[here // self.trees, candidates[at, s]]
                    np.minimum.at(low[:, s], at, values)
                    np.maximum.at(high[:, s], at, values)
            seen = np.flatnonzero(np.isfinite(low.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(low.ravel()[seen]), pa.array(high.ravel()[seen])], ["slot", "low", "high"])

        merged = state.mapInArrow(run, "slot long, low double, high double").groupBy("slot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        low, high = np.zeros(candidates.size), np.zeros(candidates.size)
        slots = merged.column("slot").to_numpy()
        low[slots], high[slots] = merged.column("low").to_numpy(), merged.column("high").to_numpy()
        return low.reshape(candidates.shape), high.reshape(candidates.shape)

    def left_counts(self, state: DataFrame, known: np.ndarray, candidates: np.ndarray, thresholds: np.ndarray, classes: int) -> np.ndarray:
        """Rows of each class that go left at each candidate's threshold."""

        def run(batches):
            counts = np.zeros(candidates.size * classes, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, keys = self.read(batch)
                here, at = _found(keys, known)
                row = here // self.trees
                for s in range(candidates.shape[1]):
                    left = x[row, candidates[at, s]] <= thresholds[at, s]
                    slot = (at[left] * candidates.shape[1] + s) * classes + y[row[left]]
                    counts += np.bincount(slot, minlength=len(counts))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["slot", "n"])

        merged = state.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        left = np.zeros(candidates.size * classes, np.int64)
        left[merged.column("slot").to_numpy()] = merged.column("n").to_numpy()
        return left.reshape(*candidates.shape, classes)


class ExtraTrees:
    """``trees`` trees of at most ``depth`` levels without resampling; a node looks at the square root of the features and takes the best of one
    random threshold each. Where all of them are constant it looks at the next ones. Rows without a label are left out."""

    def __init__(self, trees: int = 100, depth: int = 20, seed: int = 42):
        if depth > 30:
            raise ValueError("at most 30 levels")
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, df: DataFrame) -> "ExtraTreesModel":
        data = df.where("label IS NOT NULL").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        roots = (np.arange(self.trees, dtype=np.int64) << 32) | 1
        state = cut_lineage(data)
        sizes = {r.y: r.n for r in state.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            raise ValueError("no labelled rows")
        classes = max(sizes) + 1
        root = np.array([sizes.get(c, 0) for c in range(classes)], dtype=np.int64)
        width = len(state.select("x").first()[0])
        tried = max(1, int(np.sqrt(width)))
        if sum(sizes.values()) * width <= LOCAL_VALUES:
            return self._alone(state, classes, width, tried)
        state = cut_lineage(state.withColumn("places", F.lit(bytearray(roots.tobytes()))))
        nodes = [(roots, np.full(self.trees, -1), np.zeros(self.trees), np.tile(root, (self.trees, 1)))]
        importance = np.zeros(width)
        open_, counts = roots, np.tile(root, (self.trees, 1))
        if np.count_nonzero(root) < 2:
            open_ = open_[:0]
        splits: list[tuple] = []
        for level in range(self.depth):
            if not len(open_):
                break
            if len(splits) == STORED_EVERY:
                state, splits = _Rows(self.trees, width, splits).stored(state), []
            found = self._level(state, _Rows(self.trees, width, splits), open_, counts, classes, width, tried, importance)
            if found is None:
                break
            keys, feature, threshold, left, own = found
            splits = [*splits, (keys, feature, threshold)]
            nodes.append((keys, feature, threshold, own))
            tree, place = keys >> 32, keys & 0xFFFFFFFF
            kids = np.concatenate([(tree << 32) | (2 * place), (tree << 32) | (2 * place + 1)])
            kid_counts = np.concatenate([left, own - left])
            nodes.append((kids, np.full(len(kids), -1), np.zeros(len(kids)), kid_counts))
            order = np.argsort(kids)
            kids, kid_counts = kids[order], kid_counts[order]
            mixed = (kid_counts > 0).sum(axis=1) > 1
            open_, counts = kids[mixed], kid_counts[mixed]
        keys, *rest = (np.concatenate(p) for p in zip(*nodes))
        of = np.argsort(keys >> 32, kind="stable")
        trees = []
        for mine in np.split(of, np.searchsorted(keys[of] >> 32, np.arange(1, self.trees))):
            trees.append(_packed(keys[mine] & 0xFFFFFFFF, *(r[mine] for r in rest)))
        total = importance.sum()
        return ExtraTreesModel(df.sparkSession, trees, classes, importance / total if total else importance)

    def _alone(self, rows: DataFrame, classes: int, width: int, tried: int) -> "ExtraTreesModel":
        """The trees by tasks that hold all rows."""
        spark, depth, seed = rows.sparkSession, self.depth, self.seed
        table = rows.toArrow()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("x").chunks]).reshape(-1, width)
        sent = spark.sparkContext.broadcast(_Ranked(x, table.column("y").to_numpy(), classes))
        del table, x

        def run(batches):
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    packed, importance = sent.value.tree(number, depth, seed, tried)
                    columns = [pa.array([number])] + [pa.array([a.tobytes()], pa.binary()) for a in (*packed, importance)]
                    yield pa.RecordBatch.from_arrays(columns, names)

        names = ["tree", *PACKED, "importance"]
        try:
            found = spark.range(0, self.trees, 1, self.trees).mapInArrow(run, "tree long, " + ", ".join(f"{c} binary" for c in names[1:])).toArrow().sort_by("tree")
        finally:
            sent.destroy()
        trees = _unpacked(found, classes)
        importance = sum(np.frombuffer(v.as_buffer()) for v in found.column("importance"))
        total = importance.sum()
        return ExtraTreesModel(spark, trees, classes, importance / total if total else importance)

    def _level(self, state, rows, open_, counts, classes, width, tried, importance):
        """The splits of all open nodes of a level: keys, feature, threshold, counts left, own counts. Nodes without any varying feature get none."""
        found = []
        per_round = max(1, SLOTS_PER_ROUND // (tried * max(1, classes // 2)))
        for start in range(0, len(open_), per_round):
            known, own = open_[start: start + per_round], counts[start: start + per_round]
            order = np.argsort(_draws(self.seed, known, width), axis=1, kind="stable")
            chosen = order[:, :tried]
            low, high = rows.ranges(state, known, chosen)
            # Where the first features are constant, the next ones are looked at, all that are left from one more pass.
            stuck = np.flatnonzero(~(high > low).any(axis=1))
            step = max(1, SLOTS_PER_ROUND // width)
            for at in (stuck[i: i + step] for i in range(0, len(stuck), step)) if width > tried else ():
                more_low, more_high = rows.ranges(state, known[at], order[at])
                first = np.where((more_high > more_low).any(axis=1), (more_high > more_low).argmax(axis=1), 0) // tried * tried
                place = np.minimum(first[:, None] + np.arange(tried), width - 1)
                chosen[at] = np.take_along_axis(order[at], place, axis=1)
                low[at], high[at] = np.take_along_axis(more_low, place, axis=1), np.take_along_axis(more_high, place, axis=1)
            some = (high > low).any(axis=1)
            if not some.any():
                continue
            known, own, chosen, low, high = known[some], own[some], chosen[some], low[some], high[some]
            thresholds = low + np.take_along_axis(_draws(self.seed + 1, known, width), chosen, axis=1) * (high - low)
            thresholds = np.where(thresholds >= high, low, thresholds)  # never send every row left
            left = rows.left_counts(state, known, chosen, thresholds, classes)
            impurity = np.where(high > low, _gini(left) + _gini(own[:, None, :] - left), np.inf)
            best, at = impurity.argmin(axis=1), np.arange(len(known))
            np.add.at(importance, chosen[at, best], _gini(own) - impurity[at, best])
            found.append((known, chosen[at, best], thresholds[at, best], left[at, best], own))
        if not found:
            return None
        parts = [np.concatenate(p) for p in zip(*found)]
        order = np.argsort(parts[0])
        return [p[order] for p in parts]


#: The arrays of a packed tree and their kinds.
PACKED = {"feature": np.int16, "threshold": np.float64, "at": np.int32, "counts": np.int32}


def _unpacked(table: pa.Table, classes: int) -> list[tuple]:
    trees = []
    for row in range(table.num_rows):
        arrays = [np.frombuffer(table.column(c)[row].as_buffer(), kind) for c, kind in PACKED.items()]
        trees.append((*arrays[:3], arrays[3].reshape(-1, classes)))
    return trees


class ExtraTreesModel:
    """The trees as packed arrays, see :func:`_packed`."""

    def __init__(self, spark: SparkSession, trees: list[tuple], classes: int, importances: np.ndarray):
        self.trees, self.classes, self.importances = trees, classes, importances
        self._shared = spark.sparkContext.broadcast(trees)

    @property
    def nodes(self) -> pd.DataFrame:
        """All nodes as a table (tree, node, feature, threshold, left, right, shares)."""
        out = []
        for number, (feature, threshold, at, counts) in enumerate(self.trees):
            leaf, all_counts = feature < 0, np.zeros((len(feature), self.classes), np.int64)
            all_counts[leaf] = counts
            for node in np.flatnonzero(~leaf)[::-1]:
                all_counts[node] = all_counts[at[node]] + all_counts[at[node] + 1]
            cut = np.zeros(len(feature))
            cut[~leaf] = threshold
            out.append(pd.DataFrame({
                "tree": number, "node": np.arange(len(feature)), "feature": feature.astype(int), "threshold": cut, "left": np.where(leaf, -1, at),
                "right": np.where(leaf, -1, at + 1), "shares": (all_counts / all_counts.sum(axis=1, keepdims=True)).tolist()}))
        return pd.concat(out, ignore_index=True)

    def transform(self, df: DataFrame) -> DataFrame:
        shared = self._shared

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            x = np.array(features.tolist(), dtype=float)
            trees, total = shared.value, 0
            for tree in trees:
                counts = _leaf(x, tree)
                total = total + counts / counts.sum(axis=1, keepdims=True)
            return pd.Series(list(total / len(trees)))

        scored = df.withColumn("__p", probabilities(vector_to_array("features")))
        best = F.array_position("__p", F.array_max("__p")).cast("double") - 1
        return scored.withColumns({"probability": array_to_vector("__p"), "prediction": best}).drop("__p")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *(bytearray(a.tobytes()) for a in tree)) for i, tree in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree long, " + ", ".join(f"{c} binary" for c in PACKED)).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.classes, [float(i) for i in self.importances])], "classes int, importances array<double>").write.mode(
            "overwrite").parquet(f"{path}/info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ExtraTreesModel":
        info = spark.read.parquet(f"{path}/info").first()
        trees = _unpacked(spark.read.parquet(f"{path}/trees").toArrow().sort_by("tree"), info.classes)
        return cls(spark, trees, info.classes, np.array(info.importances))
