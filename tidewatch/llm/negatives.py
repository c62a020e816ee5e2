"""Hard negatives for anchors by lists shared within anchor clusters, walked until no later candidate can count."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage

#: Components are held to this much on either side: with up to ``DIMENSIONS`` of them 5 x a score stays below 2^63.
WIDEST, DIMENSIONS = 1 << 22, 1 << 14
#: Numbers a task holds of the candidates' block and of the anchors' block.
CANDIDATE_CELLS, ANCHOR_CELLS = 1 << 22, 1 << 20
#: Anchors that a shared list is made for, and the most pivots that clusters of them are made around.
MEMBERS, PIVOTS = 128, 256
#: Candidates of a list looked at between two tests for the end of the walk.
STEP = 1024
#: Stands for a row without an id; it comes after all others.
NO_ID = (1 << 63) - 1
#: Upper bounds are rounded up by this share of the largest possible score.
SLACK = 1e-7


def matrix(vectors, size: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    vectors = list(vectors)
    if all(len(v) == size for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), size)
    out = np.zeros((len(vectors), size), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``; through floating point where every sum is below 2^53."""
    most = [int(np.abs(m).max(initial=0)) for m in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class SharedList:
    """Candidates in the order of an upper bound that holds for every member of an anchor cluster.

    A member at most ``angle`` away from the cluster's direction has at least (candidate's angle - ``angle``) to the candidate, so its
    score is at most its own length times the candidate's length times the cosine of that.
    """

    def __init__(self, members: np.ndarray, candidates: np.ndarray):
        lengths, own = np.linalg.norm(candidates.astype(float), axis=1), np.linalg.norm(members.astype(float), axis=1)
        units = members / np.where(own > 0, own, 1)[:, None]
        middle = units.sum(axis=0)
        size = np.linalg.norm(middle)
        if size > 0:
            middle = middle / size
            angle = np.arccos(np.clip(units[own > 0] @ middle, -1, 1)).max(initial=0)
            away = np.arccos(np.clip(candidates @ middle / np.where(lengths > 0, lengths, 1), -1, 1))
            bounds = lengths * np.cos(np.maximum(0, away - angle)) + SLACK * lengths
        else:
            bounds = lengths * (1 + SLACK)
        self.order = np.argsort(-bounds, kind="stable")
        self.bounds = bounds[self.order]
        self.own = own

    def walk(self, members: np.ndarray, candidates: np.ndarray, need, visit) -> int:
        """Calls ``visit(rows of members, candidates' places, scores)`` step by step; ``need()`` is the least score that can still change
        the answer of each member. A member stops when the bound of the next candidate is below it. Returns the pairs scored."""
        seen = 0
        for start in range(0, len(self.order), STEP):
            going = np.flatnonzero(self.own * self.bounds[start] + SLACK >= need())
            if not len(going):
                break
            at = self.order[start:start + STEP]
            visit(going, at, scores(members[going], candidates[at]))
            seen += len(going) * len(at)
        return seen


class Best:
    """The ``most`` best (score, key) of each of ``rows`` lists: higher scores first, then smaller keys."""

    def __init__(self, rows: int, most: int):
        self.most, self.found = most, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * rows
        self.last = np.full(rows, -np.inf)

    def add(self, row: int, values: np.ndarray, keys: np.ndarray) -> None:
        good = values >= self.last[row]
        if not good.any():
            return
        values, keys = np.concatenate([self.found[row][0], values[good]]), np.concatenate([self.found[row][1], keys[good]])
        kept = np.lexsort((keys, -values))[: self.most]
        self.found[row] = values[kept], keys[kept]
        if len(kept) == self.most:
            self.last[row] = values[kept[-1]]


def _blocks(frame: pd.DataFrame) -> list[np.ndarray]:
    """Rows of the anchors that share a list: those of a cluster, a bounded number at a time."""
    return [at[i:i + MEMBERS] for at in frame.groupby("cluster", sort=True).indices.values() for i in range(0, len(at), MEMBERS)]


def _clusters(anchors: DataFrame, size: int, rows: int) -> DataFrame:
    """Adds ``cluster``, the number of the nearest of a bounded number of pivots by angle. Pivots are the anchors with the smallest hash."""
    pivots = min(PIVOTS, max(1, (1 << 20) // max(1, size)), math.ceil(rows / (MEMBERS // 2)))
    found = anchors.orderBy(F.xxhash64("uid"), "uid").select("point").limit(pivots).collect()
    middle = matrix([r.point for r in found], size).astype(float)
    middle /= np.maximum(np.linalg.norm(middle, axis=1), 1e-300)[:, None]

    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        return pd.Series((matrix(points, size) @ middle.T).argmax(axis=1) if len(points) else [], dtype="int32")

    return anchors.withColumn("cluster", nearest("point"))


def sound(vector: str) -> Column:
    return F.forall(vector, lambda v: F.coalesce(v == v, F.lit(False)) & (F.abs(v) < float("inf")))


def integer_points(vectors: DataFrame, scale: int, label: Column, anchor: Column) -> DataFrame:
    """(uid, key, label, anchor, point) of the rows with a label and a vector of finite components; ``point`` is floor(scale * x)."""
    whole = F.transform("embedding", lambda v: F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(v.cast("double") * scale))).cast("int"))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound("embedding"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("vec_id", F.lit(NO_ID)).alias("key"), label.alias("label"),
                       (F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"), whole.alias("point"))


def positives(points: DataFrame, anchors: DataFrame, size: int, most: int) -> DataFrame:
    """(uid, rank, positive_key, positive_score): the first ``most`` other rows of the label of each anchor.

    Rows of a label are dealt into bounded blocks, its anchors too; a task has one block of each.
    """
    inside, ask = max(64, CANDIDATE_CELLS // max(1, size)), max(16, ANCHOR_CELLS // max(1, size))
    asked = anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / ask).alias("parts"))
    sizes = points.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / inside).alias("blocks")).join(asked, "label")
    sizes = cut_lineage(sizes)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = points.join(sizes, "label").select("label", "uid", "key", "point", F.expr("pmod(xxhash64(uid), blocks)").alias("block"), numbers("parts").alias("part"))
    asking = anchors.join(sizes, "label").select("label", "uid", "cluster", "point", F.expr("pmod(xxhash64(cluster, uid div 64), parts)").alias("part"), numbers("blocks").alias("block"))

    def find(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            x, y, uid, keys, own = matrix(a["point"], size), matrix(c["point"], size), c["uid"].to_numpy(), c["key"].to_numpy(), a["uid"].to_numpy()
            for rows in _blocks(a):
                best = Best(len(rows), most)

                def visit(going, at, values, rows=rows, best=best):
                    for g, line in zip(going, values):
                        other = uid[at] != own[rows[g]]
                        best.add(g, line[other], keys[at][other])

                SharedList(x[rows], y).walk(x[rows], y, lambda best=best: best.last, visit)
                out += [(own[r], v, k) for r, (vs, ks) in zip(rows, best.found) for v, k in zip(vs, ks)]
        return pd.DataFrame(out, columns=["uid", "positive_score", "positive_key"]).astype("int64")

    keys = ["label", "block", "part"]
    found = asking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(find, "uid long, positive_score long, positive_key long")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def negatives(points: DataFrame, asking: DataFrame, rows: int, anchors: int, size: int, most: int, low: int, high: int) -> DataFrame:
    """(uid, positive, negative_key, negative_score): for each anchor and positive the first ``most`` rows of other labels whose score n fits
    ``low`` * p <= ``high`` * n <= ``high`` * p.

    ``asking`` has (uid, label, point, cluster, limits), limits being the positives' scores. Every pair of bounded blocks is a task's work.
    """
    blocks, parts = math.ceil(rows / max(64, CANDIDATE_CELLS // max(1, size))), math.ceil(anchors / max(16, ANCHOR_CELLS // max(1, size)))
    factor = math.gcd(low, high)
    low, high = low // factor, high // factor
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = points.select("uid", "label", "key", "point", F.expr(f"pmod(xxhash64(uid), {blocks})").cast("int").alias("block"), each(parts).alias("part"))
    asked = asking.select("uid", "label", "point", "cluster", "limits", F.expr(f"pmod(xxhash64(cluster, uid div 64), {parts})").cast("int").alias("part"), each(blocks).alias("block"))

    def find(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            x, y, keys = matrix(a["point"], size), matrix(c["point"], size), c["key"].to_numpy()
            labels, own = c["label"].to_numpy(), a["label"].to_numpy()
            for rows in _blocks(a):
                limits = [sorted(set(a["limits"].iloc[r]), reverse=True) for r in rows]
                lists = np.cumsum([0, *map(len, limits)])
                best = Best(int(lists[-1]), most)
                floor = np.array([-(-low * p // high) for ps in limits for p in ps], float)
                open_ = np.array([p >= 0 for ps in limits for p in ps], bool)

                def need(lists=lists, best=best, floor=floor, open_=open_):
                    wanted = np.where(open_, np.maximum(best.last, floor), np.inf)
                    return np.minimum.reduceat(wanted, lists[:-1])

                def visit(going, at, values, rows=rows, limits=limits, lists=lists, best=best):
                    for g, line in zip(going, values):
                        ps = limits[g]
                        fit = np.flatnonzero((labels[at] != own[rows[g]]) & (line <= ps[0]) & (high * line >= low * ps[-1]))
                        for i, p in enumerate(ps):
                            here = fit[(line[fit] <= p) & (high * line[fit] >= low * p)]
                            best.add(int(lists[g]) + i, line[here], keys[at][here])

                SharedList(x[rows], y).walk(x[rows], y, need, visit)
                uids = a["uid"].to_numpy()
                out += [(uids[r], p, v, k) for g, r in enumerate(rows) for i, p in enumerate(limits[g])
                        for v, k in zip(*best.found[int(lists[g]) + i])]
        return pd.DataFrame(out, columns=["uid", "positive_score", "negative_score", "negative_key"]).astype("int64")

    found = asked.groupBy("block", "part").cogroup(stored.groupBy("block", "part")).applyInPandas(
        find, "uid long, positive_score long, negative_score long, negative_key long")
    order = Window.partitionBy("uid", "positive_score").orderBy(F.desc("negative_score"), "negative_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(points: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (uid, key, label, anchor, point).

    A score is the integer inner product with the anchor; higher ones come first, ties by the smaller key. An anchor's positives are its
    first ``n_positives`` other rows of its label; each gets the first ``n_negatives`` rows of other labels with low * positive <= high *
    negative <= high * positive. Anchors are clustered around pivots; a cluster's candidates are sorted once by the bound of
    :class:`SharedList` and every member walks that list until the bound proves that nothing later counts, so the result is exact.

    Repeated rows are rows of their own (an anchor is not its own positive, its copy is). Rows without an id are never anchors and come
    last. Vectors of different lengths are compared as if the shorter ended in zeros. Components beyond 2^22 after scaling are held to that.
    An empty table, or one without anchors, gives no rows. Work is dealt in pairs of blocks of bounded size, whatever the labels' sizes.
    """
    points = cut_lineage(points)
    seen = points.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("int")).alias("anchors"), F.max(F.size("point")).alias("size")).first()
    if seen.n and seen["size"] > DIMENSIONS:
        raise ValueError(f"more than {DIMENSIONS} components")
    rows, size = max(1, seen.n), seen["size"] or 0
    anchors = cut_lineage(_clusters(points.where("anchor"), size, seen.anchors or 0) if seen.anchors else points.where("anchor").withColumn("cluster", F.lit(0)))
    mine = cut_lineage(positives(points, anchors, size, n_positives))
    limits = mine.groupBy("uid").agg(F.collect_set("positive_score").alias("limits"))
    asking = anchors.join(limits, "uid").select("uid", "label", "point", "cluster", "limits")
    found = negatives(points, asking, rows, max(1, seen.anchors or 0), size, n_negatives, low, high)
    ids = anchors.select("uid", F.col("key").alias("anchor_id"))
    pairs = mine.select("uid", "positive_score", "positive_key").join(found, ["uid", "positive_score"]).join(ids, "uid")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return pairs.select("anchor_id", known("positive_key").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        known("negative_key").alias("negative_id"), "positive_score", "negative_score")


_SQL = """WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS p
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.p, c.p)::BIGINT AS s
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, (row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.s DESC, n.c))::INT AS rank, n.c AS negative_id,
  p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.s DESC, n.c) <= 5"""


@query("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark, folder):
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; see :func:`hard_negatives` for edge cases.

    Anchors are the rows whose id is divisible by 100; where the id is divisible by 7 the label is first moved to the next one.
    """
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives(integer_points(vectors, 256, label, F.col("vec_id") % 100 == 0))
