"""Sources mixed to target weights: weighted fair queueing over shuffled documents, cut off at the total budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage

WEIGHTS = (1, 2, 3)
PASSES = 3
SEED = 1
#: Rows that one task sorts at a time.
SLICE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, turn, tie): ``turn`` is a hash that shuffles the documents of a source, ``tie`` one of the text."""
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("turn"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))


def targets(rows: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, target) of each source, in one row each.

    Sources take the weights in order of code points, null last. They share the total by weight; a source that would get more than
    ``passes`` times its size is held there, and the others share the rest. In the order of size by weight those held come first.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("most", passes * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = ranked.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()), "held_before": F.coalesce(F.sum("most").over(before), F.lit(0)),
        "weights_left": F.sum("weight").over(after)})
    left = F.col("total") - F.col("held_before")
    steps = steps.withColumn("held", F.col("most").cast("double") * F.col("weights_left") <= left.cast("double") * F.col("weight"))
    whole = Window.partitionBy()
    steps = steps.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("most"))).over(whole), F.lit(0)),
        "shares": F.sum(F.when(~F.col("held"), F.col("weight"))).over(whole)})
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("shares"))
    return steps.select("source", "source_size", "weight", target.alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Adds source_size, target and ``copies`` (0 to ``passes``) to the rows of :func:`sized`.

    Every source queues its shuffled documents up to ``passes`` times over; a document's finish time is the sum of sizes up to and with it by
    the source's weight. All queues are merged by finish time and cut where the sum of sizes would exceed the total of all documents.
    Documents without words take nothing. Rows that cannot be told apart share a fate.

    Sums within a source are taken in two steps, over slices of the shuffle order and inside a slice, and so is the sum over the merged queue, over slices of
    equal virtual time; so no task sees a whole source. Only the slice in which the budget ends is summed row by row.
    """
    goals = cut_lineage(targets(rows, weights, passes))
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not total:
        return rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select(
            rows["*"], "source_size", "target", F.lit(0).alias("copies"))
    digits = max(1, math.ceil(math.log(max(count / SLICE_ROWS, 1), 16)) + 1)
    rows = rows.withColumn("slice", F.substring("turn", 1, digits))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    slices = slices.join(goals, slices["source"].eqNullSafe(goals["source"])).drop(goals["source"]).withColumnsRenamed({"source": "s", "slice": "k"})
    inside = Window.partitionBy("s", "k").orderBy("turn", "doc_id", "size", "tie")
    queued = rows.join(slices, rows["source"].eqNullSafe(slices["s"]) & (rows["slice"] == slices["k"]))
    queued = queued.withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
    finish = [((F.lit(p) * F.col("source_size") + F.col("upto")).cast("double") / F.col("weight")) for p in range(passes)]
    queued = cut_lineage(queued.select(
        "doc_id", "source", "size", "turn", "tie", "source_size", "target", F.array(*finish).alias("finish")))

    # The level at which sources that are not held run out of budget; every finish below it is taken.
    level = goals.agg(F.max(F.col("target") / F.col("weight"))).first()[0]
    width = level / max(1, math.ceil(passes * count / SLICE_ROWS))
    entries = queued.where("size > 0").withColumn("at", F.explode("finish")).withColumn("part", F.floor(F.col("at") / width))
    parts = entries.groupBy("part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("upto", F.sum("n").over(Window.orderBy("part")))
    cut = parts.where(F.col("upto") > total).orderBy("part").limit(1).first()
    key = ["at", "source_known", "source", "turn", "doc_known", "doc_id", "size", "tie"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"source_known": F.col("source").isNull().cast("int"), "doc_known": F.col("doc_id").isNull().cast("int")})

    if cut is None:
        copies = F.when(F.col("size") > 0, F.lit(passes)).otherwise(F.lit(0))
        return queued.withColumn("copies", copies).drop("finish")
    near = keyed(entries.where(F.col("part") == cut.part)).withColumn("upto", (cut.upto - cut.n) + F.sum("size").over(Window.orderBy(*key)))
    last = near.where(F.col("upto") <= total).orderBy(*[F.desc(k) for k in key]).select(*key).limit(1).first()
    if last is None:
        taken = lambda at: F.floor(at / width) < cut.part
    else:
        kinds = dict(near.dtypes)
        limit = F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(key, last)])

        def taken(at):
            mine = F.struct(at.alias("at"), *[F.col(k) for k in key[1:]])
            return (F.floor(at / width) < cut.part) | ((F.floor(at / width) == cut.part) & (mine <= limit))

    flags = [taken(F.col("finish")[p]).cast("int") for p in range(passes)]
    return keyed(queued).withColumn("copies", F.when(F.col("size") > 0, sum(flags[1:], flags[0])).otherwise(F.lit(0))).drop(
        "finish", "source_known", "doc_known")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = cut_lineage(sized(docs))
    taken = mix(rows).where("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), F.col("copies").alias("__copies")).distinct()
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__tie")))
    return docs.join(taken, same).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


SQL = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size,
           md5(concat(coalesce(doc_id::varchar, ''), ':{SEED}')) AS turn FROM documents),
s AS (
    SELECT source, source_size, 3 * source_size AS most, rank, [1, 2, 3][((rank - 1) % 3 + 1)::int] AS weight
    FROM (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS rank FROM d GROUP BY source)),
t AS (
    SELECT *, most::double * weights_left <= (total - held_before)::double * weight AS held FROM (
        SELECT *, (sum(source_size) OVER ())::bigint AS total,
               coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS held_before,
               (sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::bigint AS weights_left FROM s)),
g AS (
    SELECT source, source_size, weight, total, CASE WHEN held THEN most::double ELSE
        ((total - coalesce(sum(most) FILTER (WHERE held) OVER (), 0)::bigint) * weight)::double / (sum(weight) FILTER (WHERE NOT held) OVER ())::double END AS target FROM t),
q AS (
    SELECT d.*, source_size, target, weight, total,
           (sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size))::bigint AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (
    SELECT *, (pass * source_size + upto)::double / weight AS finish FROM q CROSS JOIN (VALUES (0), (1), (2)) AS p(pass) WHERE size > 0),
k AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, doc_id NULLS LAST, size) AS queued FROM e)
SELECT q.doc_id, q.size, q.source_size, q.target, q.size * coalesce(n, 0)::bigint AS taken
FROM q LEFT JOIN (SELECT doc_id, source, turn, size, count(*) AS n FROM k WHERE queued <= total GROUP BY ALL) AS c
  ON q.doc_id = c.doc_id AND q.source IS NOT DISTINCT FROM c.source AND q.size = c.size"""


@query("op6_mixing", SQL)
def op6_mixing(spark, folder):
    """doc_id, size, source_size, target and taken of every document, equal rows included."""
    rows = cut_lineage(sized(table(spark, folder, "documents")))
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
