"""Exact k-nearest-neighbour join (Euclidean) for sides of any size.

1. Rows with the same vector are folded into one point that remembers its smallest keys, so a hot set of copies costs as much as
   a single row.
2. Points are assigned to the nearest of a bounded number of pivots, about the square root of the points. A cell with many points
   is cut into blocks. Pivots are numbered so that near ones have near numbers; consecutive blocks form a part.
3. Every query point searches one block of its own cell. The k-th distance found there rules out most other blocks: by the triangle
   inequality over the pivot, and because the points of another cell lie beyond the plane halfway between both pivots.
4. What is left is searched in a grid of (part of the queries, part of the references): a task gets the queries of one part
   that need the other one, and its needed blocks once, so a block is sent once per part of the queries. The k-th distance shrinks from block to block.
   Distances over the first coordinates after a rotation that puts most of the spread there are lower bounds too; whole
   distances are computed for the pairs that these leave.
5. The best candidates per point are merged and handed to all rows with that vector.

The result is the same as comparing every pair. In high dimensions without any clustering few blocks can be ruled out, and the
work approaches all pairs, in tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

BLOCK_ROWS = 4096
PART_ROWS, PART_VALUES = 16384, 1 << 21  # points, and numbers, of either side in one task
MAX_PIVOTS = 1024
PIVOT_VALUES = 4_000_000  # pivots x dimensions kept on every executor
CHUNK_CELLS = 2_000_000  # size of one distance matrix
PREFIX = 0.25  # share of the rotated coordinates that is looked at first


def _vector_id(vector: Column) -> Column:
    """128 bits that stand for a vector."""
    return F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), vector)))


def _rows(df: DataFrame, key: str, vector: str, within: str | None, label: str | None) -> DataFrame:
    values = F.col(vector).cast("array<double>")
    return df.select(
        F.col(key).alias("key"),
        (F.col(within).cast("string") if within else F.lit("")).alias("grp"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
        values.alias("vec"),
        _vector_id(values).alias("vid"),
    )


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest keys.

    The rank filter is applied before the shuffle too, so at most ``keep`` rows per
    vector leave a task.
    """
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("grp", "vid").orderBy("key")))
    return ranked.where(F.col("rn") <= keep).groupBy("grp", "vid").agg(
        F.first("vec").alias("vec"),
        F.sort_array(F.collect_list(F.struct("key", "label"))).alias("members"),
        F.min("key").alias("min_key"),
    )


def _in_order(points: np.ndarray, at: np.ndarray) -> list[int]:
    """The numbers ``at`` so that near points come near each other: halves along the widest direction, each ordered the same way."""
    if len(at) <= 2:
        return at.tolist()
    x = points[at] - points[at].mean(0)
    along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    order = at[np.argsort(along, kind="stable")]
    return _in_order(points, order[: len(at) // 2]) + _in_order(points, order[len(at) // 2 :])


def _pivots(points: DataFrame, n: int, block_rows: int) -> np.ndarray | None:
    """A bounded number of points by hash, near ones next to each other; none if one block holds everything."""
    if n <= block_rows:
        return None
    width = max(1, len(points.select("vec").first()[0]))
    wanted = min(MAX_PIVOTS, max(math.ceil(math.sqrt(n)), math.ceil(n / block_rows)), max(1, PIVOT_VALUES // width))
    picked = np.array([r.vec for r in points.orderBy(F.md5("vid")).limit(wanted).select("vec").collect()])
    return picked[_in_order(picked, np.arange(len(picked)))]


def _nearest_pivot(pivots: np.ndarray):
    norms = (pivots**2).sum(1)

    def assign(batches):
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), dtype=float).reshape(len(pdf), -1)
            approx = norms - 2 * x @ pivots.T if len(pdf) else np.zeros((0, len(pivots)))
            cell = approx.argmin(1) if len(pdf) else np.zeros(0, dtype=int)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) if len(pdf) else np.zeros(0)
            yield pdf.assign(cell=cell.astype("int32"), pivot_distance=far)

    return assign


def _with_cells(points: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    if pivots is None:
        return points.withColumns({"cell": F.lit(0), "pivot_distance": F.lit(0.0)})
    slim = points.select("grp", "vid", "vec", *[c for c in points.columns if c in ("members", "min_key")])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInPandas(_nearest_pivot(pivots), f"{kinds}, cell int, pivot_distance double")


def _layout(points: DataFrame, block_rows: int) -> DataFrame:
    """Per group and cell: points, range of pivot distances, blocks, and the points of the group's cells before it."""
    cells = points.groupBy("grp", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("pivot_distance").alias("near"), F.max("pivot_distance").alias("far"))
    # One row per group and pivot, so a window holds at most MAX_PIVOTS rows.
    before = Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(cells.withColumns({"blocks": F.ceil(F.col("n") / block_rows), "before": F.coalesce(F.sum("n").over(before), F.lit(0))}))


def _part(before: Column, block: Column, block_rows: int, part_rows: int) -> Column:
    return F.floor((before + block * block_rows) / part_rows)


def _placed(points: DataFrame, layout: DataFrame, block_rows: int, part_rows: int) -> DataFrame:
    """Adds the block of each point (by hash within its cell) and its part."""
    found = points.join(layout.select("grp", "cell", "blocks", "before"), ["grp", "cell"])
    found = found.withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")))
    return found.withColumn("part", _part(F.col("before"), F.col("block"), block_rows, part_rows)).drop("blocks", "before")


def _bounds(x: np.ndarray, own: np.ndarray, pivots: np.ndarray | None, cells: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances from points to the points of other cells; 0 where nothing is known."""
    if pivots is None:
        return np.zeros((len(x), len(cells)))
    there = pivots[cells]
    to_there = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (there**2).sum(1) - 2 * x @ there.T, 0))
    to_own = np.sqrt(((x - pivots[own]) ** 2).sum(1))[:, None]
    apart = np.sqrt(np.maximum((pivots[own] ** 2).sum(1)[:, None] + (there**2).sum(1) - 2 * pivots[own] @ there.T, 0))
    beyond = np.where(own[:, None] == cells, 0, (to_there**2 - to_own**2) / np.maximum(2 * apart, 1e-12))
    # Rounding of the three square roots; a bound must never be too high.
    slack = 1e-6 * (1 + np.sqrt((x**2).sum(1))[:, None] + np.sqrt((there**2).sum(1)))
    return np.maximum.reduce([to_there - far, near - to_there, np.where(apart > 1e-3 * (to_own + 1e-12), beyond, 0)]) - slack


def _close_pairs(x: np.ndarray, r: np.ndarray, limit: np.ndarray, keep: int, turn: np.ndarray | None):
    """(row, column, distance) of the pairs that may be among the ``keep`` nearest and are no farther than ``limit``, per row."""
    out = []
    r2, pr = (r**2).sum(1), None if turn is None else r @ turn
    step = max(1, CHUNK_CELLS // max(1, len(r)))
    for start in range(0, len(x), step):
        part, most = x[start : start + step], limit[start : start + step, None] ** 2 * (1 + 1e-9)
        x2 = (part**2).sum(1)[:, None]
        room = 1e-9 * (x2 + r2.max())
        close = None
        if turn is not None:
            px = part @ turn
            close = (px**2).sum(1)[:, None] + (pr**2).sum(1) - 2 * px @ pr.T <= most + room
        if close is None or close.mean() > 0.05:
            rough = x2 + r2 - 2 * part @ r.T
            if len(r) > keep:
                most = np.minimum(most, np.partition(rough, keep - 1, axis=1)[:, keep - 1 : keep])
            close = rough <= most + 2 * room
        rows, cols = np.nonzero(close)
        exact = np.empty(len(rows))
        piece = max(1, CHUNK_CELLS // max(1, x.shape[1]))
        for i in range(0, len(rows), piece):
            exact[i : i + piece] = np.sqrt(((part[rows[i : i + piece]] - r[cols[i : i + piece]]) ** 2).sum(1))
        out.append((rows + start, cols, exact))
    return [np.concatenate(part) for part in zip(*out)]


class _Running:
    """The ``keep`` nearest references of each query so far; ties by rank."""

    def __init__(self, known: np.ndarray, keep: int, rank: np.ndarray):
        self.keep, self.rank, self.limit = keep, rank, known
        self.rows, self.refs, self.far = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

    def add(self, rows: np.ndarray, refs: np.ndarray, far: np.ndarray) -> None:
        rows, refs, far = (np.concatenate(p) for p in ((self.rows, rows), (self.refs, refs), (self.far, far)))
        order = np.lexsort((self.rank[refs], far, rows))
        rows, refs, far = rows[order], refs[order], far[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.keep
        last = place == self.keep - 1
        self.limit[rows[last]] = np.minimum(self.limit[rows[last]], far[last])
        self.rows, self.refs, self.far = rows[kept], refs[kept], far[kept]


def _search(asks: DataFrame, refs: DataFrame, needs: DataFrame, pivots: np.ndarray | None, keep: int, key_type: str) -> DataFrame:
    """The nearest references of ``asks`` (grp, qpart, rpart, vid, vec, cell, kth, home) among the blocks that ``needs`` names for (grp, qpart, rpart).

    Returns candidates (grp, vid, rid, min_key, distance), and a row without vid per task that says how many pairs it looked at.
    """
    turn = None
    if pivots is not None:
        spread = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2]
        turn = spread[: max(1, int(PREFIX * pivots.shape[1]))].T

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"grp": [], "vid": [], "rid": [], "min_key": [], "distance": [], "pairs": []}, dtype=object)
        q, r = np.array(left["vec"].tolist()), np.array(right["rvec"].tolist())
        running = _Running(left["kth"].fillna(np.inf).to_numpy(dtype=float, copy=True), keep, right["rkey"].rank(method="first").to_numpy())
        blocks = [(cell, block, at) for (cell, block), at in right.groupby(["rcell", "rblock"]).indices.items()]
        cells = np.array([c for c, _, _ in blocks], dtype=int)
        pd_ = right["rdistance"].to_numpy()
        near, far = (np.array([f(pd_[at]) for _, _, at in blocks]) for f in (np.min, np.max))
        lowest = _bounds(q, left["cell"].to_numpy(dtype=int), pivots, cells, near, far)
        home, pairs = left["home"].to_numpy(), 0
        for b in np.argsort(lowest.mean(0), kind="stable"):
            cell, block, at = blocks[b]
            rows = np.flatnonzero((lowest[:, b] <= running.limit * (1 + 1e-9)) & (home != f"{cell}/{block}"))
            if len(rows):
                pairs += len(rows) * len(at)
                i, j, d = _close_pairs(q[rows], r[at], running.limit[rows], keep, turn)
                running.add(rows[i], at[j], d)
        found = pd.DataFrame({
            "grp": left["grp"].to_numpy()[running.rows], "vid": left["vid"].to_numpy()[running.rows], "rid": right["rid"].to_numpy()[running.refs],
            "min_key": right["rkey"].to_numpy()[running.refs], "distance": running.far, "pairs": np.nan,
        })
        looked = pd.DataFrame({"grp": [left["grp"].iloc[0]], "vid": [None], "rid": [None], "min_key": [None], "distance": [np.nan], "pairs": [pairs]})
        return pd.concat([found.astype(object), looked.astype(object)]) if len(found) else looked.astype(object)

    # Other names on this side: both sides may stem from the same table.
    keys = ["grp", "qpart", "rpart"]
    sent = refs.select(F.col("grp").alias("rgrp"), F.col("cell").alias("rcell"), F.col("block").alias("rblock"), F.col("pivot_distance").alias("rdistance"),
                       F.col("vid").alias("rid"), F.col("vec").alias("rvec"), F.col("min_key").alias("rkey"))
    sent = sent.join(needs.select(F.col("grp").alias("rgrp"), F.col("qpart").alias("for_qpart"), F.col("rpart").alias("for_rpart"),
                                  F.col("cell").alias("rcell"), F.col("block").alias("rblock")), ["rgrp", "rcell", "rblock"])
    sent = sent.groupBy("rgrp", "for_qpart", "for_rpart")
    return asks.select(*keys, "vid", "vec", "cell", "kth", "home").groupBy(*keys).cogroup(sent).applyInPandas(
        search, f"grp string, vid string, rid string, min_key {key_type}, distance double, pairs double")


def _routes(asking: DataFrame, layout: DataFrame, pivots: np.ndarray, keep: int, block_rows: int, part_rows: int) -> DataFrame:
    """(grp, qpart, rpart, vid, cell, block): rows with a vid send that query to a part; rows without one name a block the part must send.

    Every part of the queries gets its group's layout, a row per cell.
    """

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["grp", "qpart", "rpart", "vid", "cell", "block"]
        out = [pd.DataFrame({c: [] for c in names}, dtype=object)]
        if len(left) and len(right):
            right = right.sort_values("rcell")  # so that the blocks of a part follow each other
            times = right["blocks"].to_numpy(dtype=int)
            of = np.repeat(np.arange(len(right)), times)
            block = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            rpart = (right["before"].to_numpy()[of] + block * block_rows) // part_rows
            cells = right["rcell"].to_numpy(dtype=int)
            labels = np.array([f"{c}/{b}" for c, b in zip(cells[of], block)])
            parts, first = np.unique(rpart, return_index=True)
            asked = np.zeros(len(of), bool)
            grp, qpart = left["grp"].iloc[0], left["qpart"].iloc[0]
            enough = right["n"].to_numpy() >= keep
            step = max(1, CHUNK_CELLS // len(of))
            for start in range(0, len(left), step):
                rows = left.iloc[start : start + step]
                x = np.array(rows["vec"].tolist())
                there = pivots[cells]
                reach = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (there**2).sum(1) - 2 * x @ there.T, 0)) + right["far"].to_numpy()
                limit = np.minimum(rows["kth"].fillna(np.inf).to_numpy(), np.where(enough, reach, np.inf).min(1) * (1 + 1e-6) + 1e-6)
                lowest = _bounds(x, rows["cell"].to_numpy(dtype=int), pivots, cells, right["near"].to_numpy(), right["far"].to_numpy())
                needed = (lowest <= limit[:, None] * (1 + 1e-9))[:, of] & (rows["home"].to_numpy()[:, None] != labels)
                asked |= needed.any(0)
                i, p = np.nonzero(np.logical_or.reduceat(needed, first, axis=1))
                out.append(pd.DataFrame({"grp": grp, "qpart": qpart, "rpart": parts[p], "vid": rows["vid"].to_numpy()[i], "cell": None, "block": None}))
            at = np.flatnonzero(asked)
            out.append(pd.DataFrame({"grp": grp, "qpart": qpart, "rpart": rpart[at], "vid": None, "cell": cells[of][at], "block": block[at]}))
        return pd.concat([o.astype(object) for o in out])

    # Other names on this side, as above.
    known = layout.select(F.col("grp").alias("rgrp"), F.col("cell").alias("rcell"), "blocks", "before", "n", "near", "far")
    known = known.join(asking.select(F.col("grp").alias("rgrp"), F.col("qpart").alias("for_qpart")).distinct(), "rgrp")
    left = asking.select("grp", "qpart", "vid", "vec", "cell", "kth", "home")
    return left.groupBy("grp", "qpart").cogroup(known.groupBy("rgrp", "for_qpart")).applyInPandas(
        route, "grp string, qpart long, rpart long, vid string, cell int, block long")


def _candidates(query_points: DataFrame, ref_points: DataFrame, itself: bool, keep: int, key_type: str, block_rows: int) -> DataFrame:
    """The nearest reference points of each query point, and how many pairs were looked at; see :func:`_search`."""
    n, asked = ref_points.count(), query_points.count()
    pivots = _pivots(ref_points, n, block_rows)
    width = len(ref_points.select("vec").first()[0]) if n else 1
    part_rows = max(block_rows, min(PART_ROWS, PART_VALUES // max(1, width)))
    ref_cells = _with_cells(ref_points, pivots)
    query_cells = _with_cells(query_points, pivots)
    if pivots is not None:
        ref_cells = cut_lineage(ref_cells)
        query_cells = ref_cells if itself else cut_lineage(query_cells)
    layout = _layout(ref_cells, block_rows)
    refs = _placed(ref_cells, layout, block_rows, part_rows)
    tasks = query_points.sparkSession.sparkContext.defaultParallelism
    query_rows = min(part_rows, max(64, math.ceil(asked / tasks)))
    query_block = min(block_rows, query_rows)
    asking = _placed(query_cells.select("grp", "vid", "vec", "cell"), _layout(query_cells, query_block), query_block, query_rows)
    asking = asking.select("grp", "vid", "vec", "cell", F.col("part").alias("qpart"))

    # The home block: one block of the query's own cell, if that cell has reference points.
    sizes = layout.select("grp", "cell", "blocks", "before")
    home = F.pmod(F.xxhash64("vid"), F.col("blocks"))
    asking = asking.join(sizes, ["grp", "cell"], "left").withColumn("hblock", home)
    asking = asking.withColumn("home", F.concat(F.col("cell").cast("string"), F.lit("/"), F.col("hblock").cast("string"))).drop("blocks", "before")
    at_home = asking.where("hblock IS NOT NULL").withColumn("rpart", F.xxhash64("home"))
    needs = at_home.select("grp", "qpart", "rpart", "cell", F.col("hblock").alias("block")).distinct()
    first = at_home.withColumns({"kth": F.lit(None).cast("double"), "home": F.lit("")})
    found = _search(first, refs, needs, pivots, keep, key_type)
    if pivots is None:
        return found
    found = cut_lineage(found)
    kth = found.where("vid IS NOT NULL").groupBy("grp", "vid").agg(F.when(F.count(F.lit(1)) >= keep, F.max("distance")).alias("kth"))
    known = cut_lineage(asking.withColumn("home", F.coalesce("home", F.lit(""))).join(kth, ["grp", "vid"], "left"))
    routes = cut_lineage(_routes(known, layout, pivots, keep, block_rows, part_rows))
    asks = routes.where("vid IS NOT NULL").select("grp", "qpart", "rpart", "vid").join(known.drop("qpart"), ["grp", "vid"])
    return found.unionByName(_search(asks, refs, routes.where("vid IS NULL"), pivots, keep, key_type))


def nearest(
    queries: DataFrame,
    refs: DataFrame | None,
    key: str,
    vector: str,
    k: int,
    within: str | None = None,
    label: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, neighbors): the k nearest reference rows, by distance and then key.

    ``refs=None`` joins a table with itself; a row is then not its own neighbour.
    ``within`` restricts neighbours to the same value of that column, and ``label``
    is carried along in ``neighbors`` (distance, key, label).
    """
    itself = refs is None
    keep = k + 1 if itself else k
    query_rows = _rows(queries, key, vector, within, label)
    key_type = query_rows.schema["key"].dataType.simpleString()
    ref_points = cut_lineage(_points(query_rows if itself else _rows(refs, key, vector, within, label), keep))
    if itself:
        query_points = ref_points
    else:
        query_points = cut_lineage(query_rows.groupBy("grp", "vid").agg(F.first("vec").alias("vec")))

    found = _candidates(query_points, ref_points, itself, keep, key_type, block_rows).where("vid IS NOT NULL")
    best = Window.partitionBy("grp", "vid")
    candidates = found.withColumn("rn", F.row_number().over(best.orderBy("distance", "min_key"))).where(F.col("rn") <= keep)
    members = ref_points.select(F.col("grp"), F.col("vid").alias("rid"), F.explode("members").alias("m"))
    single = candidates.join(members, ["grp", "rid"]).select("grp", "vid", "distance", "m.key", "m.label")
    ranked = single.withColumn("rn", F.row_number().over(best.orderBy("distance", "key"))).where(F.col("rn") <= keep)
    lists = ranked.groupBy("grp", "vid").agg(
        F.sort_array(F.collect_list(F.struct("distance", "key", "label"))).alias("neighbors")
    )
    joined = query_rows.select("key", "grp", "vid").join(lists, ["grp", "vid"], "left")
    neighbors = F.coalesce("neighbors", F.array().cast(lists.schema["neighbors"].dataType))
    if itself:
        neighbors = F.filter(neighbors, lambda x: x.key != F.col("key"))
    return joined.select(F.col("key").alias(key), F.slice(neighbors, 1, k).alias("neighbors"))


def pairs_looked_at(queries: DataFrame, refs: DataFrame | None, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> float:
    """The share of all pairs of distinct vectors that a search looks at in blocks, for choosing ``block_rows``."""
    itself = refs is None
    rows = lambda df: _rows(df.withColumn("__at", F.monotonically_increasing_id()), "__at", vector, None, None)
    ref_points = cut_lineage(_points(rows(queries if itself else refs), 1))
    query_points = ref_points if itself else cut_lineage(rows(queries).groupBy("grp", "vid").agg(F.first("vec").alias("vec")))
    looked = _candidates(query_points, ref_points, itself, k + itself, "bigint", block_rows).agg(F.sum("pairs")).first()[0]
    return (looked or 0) / max(1, ref_points.count() * query_points.count())


def neighbor_rows(joined: DataFrame, key: str) -> DataFrame:
    """One row per neighbour with its rank, counted from 1."""
    return joined.select(key, F.posexplode("neighbors").alias("at", "n")).select(
        key, (F.col("at") + 1).alias("rank"), F.col("n.key").alias("neighbor"), F.col("n.distance").alias("distance")
    )


def vote(joined: DataFrame) -> Column:
    """The most frequent label among the neighbours, the lowest one on ties."""
    labels = F.transform("neighbors", lambda n: n.label)
    counted = F.transform(
        F.array_distinct(labels),
        lambda l: F.struct((-F.size(F.filter(labels, lambda x: x == l))).alias("votes"), l.alias("label")),
    )
    return F.array_min(counted).label


def classify(queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, prediction): k-nearest-neighbour vote."""
    with_label = queries if label in queries.columns else queries.withColumn(label, F.lit(None).cast(train.schema[label].dataType))
    joined = nearest(with_label, train, key, vector, k, label=label, block_rows=block_rows)
    return joined.select(key, vote(joined).alias("prediction"))


def vote_shares(joined: DataFrame, classes: list) -> Column:
    """Share of the neighbours per class: the class probabilities of the vote."""
    labels = F.transform("neighbors", lambda n: n.label)
    return F.array(*[_share(labels, F.lit(c)) for c in classes])


def _share(labels: Column, c: Column) -> Column:
    return F.try_divide(F.size(F.filter(labels, lambda x: x == c)).cast("double"), F.size(labels).cast("double"))
