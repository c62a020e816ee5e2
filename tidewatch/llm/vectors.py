"""Near-duplicate vectors by sorted projection passes, with exact link counts inside the components found."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import components
from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage

COSINE = 0.98
WINDOW = 32
HASH_BITS = 48
#: Share of pairs at the threshold that all passes together may miss, and the least and largest number of passes.
MISS, LEAST_PASSES, MOST_PASSES = 0.002, 8, 96
BLOCK, PACK = 1024, 2000
SEED = 17


def passes_for(rows: int, window: int = WINDOW, cosine: float = COSINE, common: float = 0.0, bits: float | None = None) -> int:
    """Passes after which a pair at the threshold is missed with a chance of ``MISS`` at most among ``rows`` vectors of a label.

    A pair meets in a pass if its hashes agree in the first ``bits`` that tell a window from the rest: log2(rows / window) for
    vectors in all directions, more where they crowd. ``common`` is the mean cosine of two vectors: hashes are taken from the label's mean, from
    where the same pair stands at a wider angle.
    """
    there = max(-1.0, min(1.0, (cosine - common) / (1 - common) if common < 1 else 1.0))
    least = max(0.0, math.log2(max(rows, 1) / window))
    meet = (1 - math.acos(there) / math.pi) ** max(least, bits or 0.0)
    wanted = math.log(MISS) / math.log(1 - min(max(meet, 1e-9), 0.99))
    return max(LEAST_PASSES, min(MOST_PASSES, math.ceil(wanted)))


def label_means(points: DataFrame, window: int = WINDOW) -> DataFrame:
    """(label, size, n, middle, common) of labels with more points than a window: the mean of the unit vectors and the mean cosine of two of them.

    Every task sums its own points, then one row a label, length and component is shuffled.
    """
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = points.select("label", "size", F.transform("embedding", lambda x: x.cast("double") / most).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    parts = scaled.select("label", "size", F.posexplode(F.transform("v", lambda x: x / length)).alias("at", "x"))
    sums = parts.groupBy("label", "size", "at").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")).where(F.col("n") > window)
    rows = sums.groupBy("label", "size").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("square"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("all"))
    common = (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return rows.select("label", "size", "n", F.transform("all", lambda e: e["x"] / F.col("n")).alias("middle"), F.greatest(F.lit(0.0), common).alias("common"))


def crowding(points: DataFrame, window: int = WINDOW) -> float:
    """The leading bits after which half the rows of each label share them with no more than a window of others, in the first pass.

    Half, because rows of large groups of near copies never part, and need not: they are linked with each other anyway.
    """
    keys = hashed(points, 1).select("label", "size", F.explode(F.array(*map(F.lit, range(0, HASH_BITS, 2)))).alias("bits"), "key")
    keys = keys.groupBy("label", "size", "bits", F.expr(f"shiftright(key, {HASH_BITS} - bits)").alias("first")).agg(F.count(F.lit(1)).alias("n"))
    crowded = F.coalesce(F.sum(F.when(F.col("n") > window, F.col("n"))), F.lit(0)) / F.sum("n")
    worst = keys.groupBy("label", "size", "bits").agg(crowded.alias("share")).groupBy("bits").agg(F.max("share").alias("share")).where("share > 0.5")
    last = worst.agg(F.max("bits")).first()[0]
    return 0.0 if last is None else last + 2.0


def _unit(values: pa.Array, size: int) -> np.ndarray:
    return _normed(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are first scaled by a power of two, which changes no digit and keeps squares of very large numbers finite."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _runs(keys: np.ndarray):
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]))


def hashed(points: DataFrame, passes: int) -> DataFrame:
    """(pass, key, node, label, size, embedding): the key is a row of signs of random projections, the first as the highest bit.

    Projections are taken from ``middle``, the mean direction of the label, where there is one: signs from the origin would hardly split vectors that share a direction.
    """
    schema = T.StructType([*points.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    powers = (1 << np.arange(HASH_BITS - 1, -1, -1)).astype(np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            keys = np.zeros((batch.num_rows, passes), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes = {size: np.random.default_rng([SEED, int(size)]).standard_normal((passes, int(size), HASH_BITS))}
                x = _unit(batch.column("embedding").take(pa.array(at)), int(size))
                middle = batch.column("middle").take(pa.array(at))
                known = np.flatnonzero(middle.is_valid().to_numpy(zero_copy_only=False))
                if len(known):
                    x[known] -= middle.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size))
                for p in range(passes):
                    keys[at, p] = (x @ planes[size][p] > 0) @ powers
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return points.mapInArrow(run, schema).select("node", "label", "size", "embedding", F.posexplode("keys").alias("pass", "key"))


def window_links(points: DataFrame, passes: int, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """Links (a, b) with at least ``cosine`` between vectors that are at most ``window`` apart in the order of a pass.

    All passes are sorted at once, by ranges with the node as the last key, so equal hashes are dealt over tasks too. A task
    returns only links that join what its earlier links do not.
    """
    ordered = hashed(points, passes).repartitionByRange("pass", "label", "size", "key", "node").sortWithinPartitions("pass", "label", "size", "key", "node")

    def run(batches):
        kept = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            keys = np.column_stack([whole.column(c).to_numpy() for c in ("pass", "label", "size")])
            nodes, embedded = whole.column("node").to_numpy(), whole.column("embedding").chunk(0) if whole.num_rows else None
            links = []
            for start, end in _runs(keys):
                x = _unit(embedded.slice(start, end - start), int(keys[start, 2]))
                parent = np.arange(end - start)

                def find(i, parent=parent):
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for step in range(1, min(window, end - start - 1) + 1):
                    for i in np.flatnonzero(np.einsum("ij,ij->i", x[step:], x[:-step]) >= cosine):
                        a, b = find(i), find(i + step)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            links.append((nodes[start + i], nodes[start + i + step]))
            ends = whole.slice(max(0, whole.num_rows - window))
            kept = ends.to_batches()[0] if ends.num_rows else None
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def link_counts(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, links): how many vectors each node of (root, node, n, embedding) links with inside its component, copies counted.

    Windows are bounded, so in a dense group they reach only some of a vector's links. Here each component is compared in blocks: a task has one pair of
    blocks, or a pack of whole small components, and returns a count per vector, never the pairs.
    """
    sizes = cut_lineage(members.groupBy("root").agg(F.count(F.lit(1)).alias("k")))
    small = sizes.where(F.col("k") <= BLOCK).agg(F.sum("k")).first()[0] or 0
    packs = max(1, math.ceil(small / PACK))
    sized = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("k") / BLOCK))
    block = F.expr("pmod(xxhash64(node), blocks)")
    whole = sized.where("blocks = 1").select(
        F.expr(f"-1 - pmod(xxhash64(root), {packs})").alias("pack"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"),
        F.lit(0).alias("side"), "root", "node", "n", "embedding")
    split = sized.where("blocks > 1").withColumn("block", block)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(
        F.least(F.col("block"), other).alias("i"), F.greatest(F.col("block"), other).alias("j"), (F.col("block") > other).cast("int").alias("side")))
    split = split.withColumn("cell", F.explode(cells)).select(
        F.col("root").alias("pack"), "cell.i", "cell.j", "cell.side", "root", "node", "n", "embedding")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("root"):
            x = _normed(np.array(part["embedding"].tolist(), np.float64))
            n, side, nodes = part["n"].to_numpy(), part["side"].to_numpy(), part["node"].to_numpy()
            if part["i"].iloc[0] == part["j"].iloc[0]:
                linked = x @ x.T >= cosine
                np.fill_diagonal(linked, False)
                out.append(pd.DataFrame({"node": nodes, "links": linked @ n}))
            else:
                linked = x[side == 0] @ x[side == 1].T >= cosine
                out.append(pd.DataFrame({"node": nodes[side == 0], "links": linked @ n[side == 1]}))
                out.append(pd.DataFrame({"node": nodes[side == 1], "links": linked.T @ n[side == 0]}))
        return pd.concat(out)

    counts = whole.unionByName(split).groupBy("pack", "i", "j").applyInPandas(count, "node long, links long")
    return counts.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label).

    Vectors are compared within a label and a length. Equal vectors of a label are folded into one point before the passes and counted again
    after. Null labels and ids, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Rows that
    share an id are one vector, the one with the smallest (label, embedding); all are returned.
    """
    one = vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.*")
    sound = F.forall("embedding", lambda v: F.coalesce(v == v, F.lit(False)) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    sound = cut_lineage(one.where(F.col("label").isNotNull() & (F.size("embedding") > 0) & sound))
    points = cut_lineage(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    whole = isinstance(points.schema["label"].dataType, T.IntegralType)
    dealt = points.select("node", (F.col("label").cast("long") if whole else F.xxhash64("label")).alias("label"), F.size("embedding").alias("size"), "embedding")
    means = cut_lineage(label_means(dealt, window))
    seen = means.agg(F.max("n").alias("most"), F.max("common").alias("common")).first()
    dealt = cut_lineage(dealt.join(means.select("label", "size", "middle"), ["label", "size"], "left"))
    passes = LEAST_PASSES if seen.most is None else passes_for(seen.most, window, cosine, seen.common, crowding(dealt, window))
    found = components(window_links(dealt, passes, window, cosine))
    linked = cut_lineage(link_counts(found.join(points, "node").select("root", "node", "n", "embedding"), cosine).join(found, "node"))
    nodes = points.join(linked, "node", "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    results = sound.join(nodes, ["label", "embedding"]).select(F.col("vec_id").alias("__id"), "n_links", "component_id")
    rows = vectors.select("vec_id").join(results, F.col("vec_id") == F.col("__id"), "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op7_embedding_dedup")
def op7_embedding_dedup(spark, folder):
    """vec_id, n_links, component_id and kept of every vector."""
    return near_duplicates(table(spark, folder, "embeddings"))
