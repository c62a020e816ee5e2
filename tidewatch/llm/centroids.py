"""Exact k-means rounds over integer vectors by the Shallot search: bounds that remember the second-nearest centroid too."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage

#: Components are held to this much on either side, so that squared distances of up to 4,096 components stay below 2^63.
WIDEST = 1 << 24
DIMENSIONS = 4096
#: Bounds are square roots in double precision; they are widened by this share, so rounding never rules out a centroid.
SLACK = 1e-9


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a centroid, or row by row to several, as 64-bit integers."""
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Shallot:
    """The search among fixed centroids: ``assign`` finds the nearest centroid of every row; of equally near ones the first.

    A row carries the number of its nearest and of its second-nearest centroid (``first``, ``second``), an upper bound of its distance to the
    one and a lower bound of its distance to all others (``upper``, ``lower``).
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        k = len(centroids)
        gaps = np.array([np.sqrt(squared(self.centroids, c).astype(float)) for c in self.centroids]).reshape(k, k)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1) * (1 - SLACK)
        # A centroid's own place in its list is not sure to be the first, because others may be equal to it.
        apart = gaps + np.diag(np.full(k, np.inf))
        self.half = apart.min(axis=1) / 2 * (1 - SLACK) if k else np.zeros(0)
        self.compared = 0

    def assign(self, x: np.ndarray, first, second, upper, lower) -> np.ndarray:
        """Updates the four arrays in place and returns the squared distance to the nearest centroid of every row."""
        distance = squared(x, self.centroids[first])
        upper[:] = np.sqrt(distance) * (1 + SLACK)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[first]))
        self.compared += len(x)
        if len(self.centroids) > 1 and len(open_):
            self._search(x, open_, distance, first, second, upper, lower)
        return distance

    def _search(self, x, rows, distance, first, second, upper, lower) -> None:
        a, b = first[rows].copy(), second[rows].copy()
        to_a, to_b = distance[rows], squared(x[rows], self.centroids[b])
        self.compared += len(rows)
        turned = (to_b < to_a) | ((to_b == to_a) & (b < a))
        a[turned], b[turned] = b[turned], a[turned]
        to_a[turned], to_b[turned] = to_b[turned], to_a[turned]
        start = a.copy()
        reach = np.sqrt(to_a) * (1 + SLACK)
        for centre in np.unique(start):
            at = np.flatnonzero(start == centre)
            for place in range(len(self.centroids)):
                # Only centroids this near to the centre can be nearer than the second-nearest one so far: the ball shrinks with it.
                at = at[self.gaps[centre, place] <= reach[at] + np.sqrt(to_b[at]) * (1 + SLACK)]
                if not len(at):
                    break
                other = self.order[centre, place]
                new = at[(a[at] != other) & (b[at] != other)]
                if not len(new):
                    continue
                near = squared(x[rows[new]], self.centroids[other])
                self.compared += len(new)
                wins = (near < to_a[new]) | ((near == to_a[new]) & (other < a[new]))
                then = ~wins & (near < to_b[new])
                won, next_ = new[wins], new[then]
                b[won], to_b[won] = a[won], to_a[won]
                a[won], to_a[won] = other, near[wins]
                b[next_], to_b[next_] = other, near[then]
        first[rows], second[rows], distance[rows] = a, b, to_a
        upper[rows], lower[rows] = np.sqrt(to_a) * (1 + SLACK), np.sqrt(to_b) * (1 - SLACK)


def _rows(batch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def integer_vectors(vectors: DataFrame, size: int, scale: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``point``, floor(scale * x) of each component: rows with ``size`` components, none null or non-finite."""
    sound = F.forall("embedding", lambda v: F.coalesce(v == v, F.lit(False)) & (F.abs(v) < float("inf")))
    whole = F.transform("embedding", lambda v: F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(v.cast("double") * scale))).cast("int"))
    return vectors.where((F.size("embedding") == size) & sound).select(*keep, whole.alias("point"))


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows of ``state`` with their nearest centroid, distance and bounds; ``moved`` says how far each centroid went since the last time."""
    size = centroids.shape[1]
    keep = [c for c in state.columns if c not in ("first", "second", "upper", "lower", "distance")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields if f.name in keep)

    def run(batches):
        search = Shallot(centroids)
        for batch in batches:
            x, n = _rows(batch, "point", size), batch.num_rows
            if moved is None:
                first, second = np.zeros(n, np.int32), np.full(n, min(1, len(centroids) - 1), np.int32)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                first, second, upper, lower = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second", "upper", "lower"))
                far = np.argsort(moved)[::-1]
                rest = np.where(first == far[0], moved[far[min(1, len(far) - 1)]], moved[far[0]])
                lower = lower - rest
            distance = search.assign(x, first, second, upper, lower)
            columns = [*(batch.column(c) for c in keep), *map(pa.array, (first, second, upper, lower, distance))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "first", "second", "upper", "lower", "distance"])

    return state.mapInArrow(run, schema + ", first int, second int, upper double, lower double, distance long")


def cluster_sums(state: DataFrame, size: int) -> DataFrame:
    """(first, at, total, n) for each cluster and component: every task adds up its rows, then one row a cluster and component is shuffled."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            x, first = _rows(batch, "point", size), batch.column("first").to_numpy(zero_copy_only=False)
            for c in np.unique(first).tolist():
                mine = x[first == c]
                totals[c] = totals.get(c, 0) + mine.sum(axis=0)
                counts[c] = counts.get(c, 0) + len(mine)
        for c, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, c, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total), pa.array(np.full(size, counts[c]))],
                ["first", "at", "total", "n"])

    parts = state.select("point", "first").mapInArrow(run, "first int, at int, total long, n long")
    return parts.groupBy("first", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def first_centroids(points: DataFrame, order: str, k: int) -> np.ndarray:
    """The ``k`` vectors that come first by ``order`` (null last) and then by their components: a driver table of k rows."""
    found = points.orderBy(F.expr(order).asc_nulls_last(), "point").select("point").limit(k).collect()
    return np.array([r.point for r in found], np.int64)


def clustered(vectors: DataFrame, k: int, rounds: int, size: int, scale: int, order: str, keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``keep``, cluster and distance of each kept vector after ``rounds`` exact rounds and a last assignment, and the final centroids.

    ``order`` is an expression over the columns ``keep``; the vectors that it puts first are the centroids to begin with. An empty cluster
    keeps its centroid. Rows that are not ``size`` finite components are left out; repeated rows count each. With fewer vectors than ``k`` there
    are as many clusters as vectors. Each round reads the vectors once, with their bounds of the round before, and writes them to the shared folder. Components
    beyond 2^24 after scaling are held to that. The centroids (k x size integers) are all that the driver and every task hold.
    """
    if size > DIMENSIONS:
        raise ValueError(f"more than {DIMENSIONS} components")
    if clash := {"point", "first", "second", "upper", "lower", "distance", "cluster"} & set(keep):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    state = cut_lineage(integer_vectors(vectors, size, scale, keep))
    centroids, moved = first_centroids(state, order, k), None
    if not len(centroids):
        none = state.select(*keep, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, np.zeros((0, size), np.int64)
    for _ in range(rounds):
        state = cut_lineage(assigned(state, centroids, moved))
        means = centroids.copy()
        for r in cluster_sums(state, size).collect():
            means[r["first"], r["at"]] = int(r["total"]) // r["n"]
        moved = np.sqrt(squared(means, centroids)) * (1 + SLACK)
        centroids = means
    state = cut_lineage(assigned(state, centroids, moved))
    return state.select(*keep, F.col("first").alias("cluster"), "distance"), centroids


_FIRST = "SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS p FROM embeddings " \
    "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = 64"
_PICK = "SELECT {c}.vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT pts.vec_id, {c}.k, " \
    "list_sum(list_transform(list_zip(pts.p, {c}.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pts, {c}) {c} GROUP BY 1"
_MOVE = """SELECT o.k, coalesce(m.c, o.c) AS c FROM {c} o LEFT JOIN (SELECT k, list(f ORDER BY i) AS c FROM (
  SELECT k, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f
  FROM {a} JOIN (SELECT vec_id, unnest(p) AS v, unnest(range(64)) AS i FROM pts) USING (vec_id) GROUP BY k, i) GROUP BY k) m USING (k)"""
_SQL = "WITH pts AS MATERIALIZED (" + _FIRST + """), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, p AS c FROM (SELECT sha256('1:' || vec_id) AS h, p FROM pts ORDER BY h LIMIT 16)),
""" + ",\n".join(
    f"a{r} AS MATERIALIZED ({_PICK.format(c=f'c{r}')})" + (f", c{r + 1} AS MATERIALIZED ({_MOVE.format(c=f'c{r}', a=f'a{r}')})" if r < 3 else "") for r in range(4)) + """
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k)"""


@query("op12_centroids", _SQL)
def op12_centroids(spark, folder):
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of 64 finite components, after three rounds.

    Other rows are left out; repeated rows each count; a null id is the last choice for a first centroid.
    """
    found, centroids = clustered(
        table(spark, folder, "embeddings").select("vec_id", "embedding"), 16, 3, 64, 64, "sha2(concat('1:', vec_id), 256)", ["vec_id"])
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    digests = F.array(*map(F.lit, texts)) if texts else F.array(F.lit(""))
    sums = sums.withColumn("centroid_sha256", F.sha2(F.element_at(digests, F.col("cluster") + 1), 256))
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
