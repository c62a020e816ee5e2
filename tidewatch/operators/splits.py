"""Exact, reproducible splits, folds, samples and undersampling.

Rows are ordered by the md5 of ``key:seed`` within each class; a split is then a
set of cut values per class, one for each wanted number of rows. Finding the cuts
takes two aggregations (counts per hash prefix, then the rows of the few prefixes
that hold a cut), and applying them is a comparison within the row: the table is
never sorted or shuffled, however many rows one class holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import as_column, quoted
from tidewatch.session import small_table

PREFIX_DIGITS = 4  # 65,536 prefixes, so a prefix holds about 1/65,536 of a class
SORTED_ROWS = 200_000  # a prefix with more rows is divided by further digits before its rows are put in order
NO_CLASS = "\u0000"
BEFORE_ALL = ""
AFTER_ALL = "g"  # sorts behind every hexadecimal digit


def row_hash(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(as_column(key).cast("string"), F.lit(f":{seed}")))


def hash_fraction(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts (columns or constants) joined by ``:``."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _spelled(column: Column, kind: T.DataType) -> Column:
    """A value as text that no other value of the column has: null or not, length, and all digits of numbers and times."""
    if isinstance(kind, T.BinaryType):
        text = F.hex(column)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.concat(F.to_json(column), F.lit("|"), column.cast("string"))
    else:
        text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def with_content_key(df: DataFrame, output: str = "row_key", chunk: int = 100_000) -> DataFrame:
    """A unique key for tables without one: the hash of the whole row and the number of the copy.

    Copies are counted (which reduces them before the shuffle) and then written out
    again with their numbers. A row with very many copies is written out by several
    tasks, ``chunk`` copies each. The keys depend on the contents only.
    """
    columns = [F.col(quoted(c)) for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__first", F.lit(0).cast("long"))
    many = F.col("__copies") > chunk
    pieces = F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(chunk).cast("long"))
    hot = counted.where(many).withColumn("__first", F.explode(pieces))
    hot = hot.withColumn("__copies", F.least(F.col("__copies"), F.col("__first") + chunk)).repartition(*columns, "__first")
    rest = counted.where(~many)
    numbered = rest.unionByName(hot).withColumn("__copy", F.explode(F.sequence("__first", F.col("__copies") - 1)))
    content = F.md5(F.concat(*[_spelled(c, df.schema[n].dataType) for c, n in zip(columns, df.columns)]))
    return numbered.withColumn(output, F.concat(content, F.lit("-"), F.col("__copy").cast("string"))).drop(
        "__copies", "__first", "__copy"
    )


def _class_text(label: str | None) -> Column:
    return F.lit(NO_CLASS) if label is None else F.coalesce(F.col(label).cast("string"), F.lit(NO_CLASS))


def hash_cuts(
    df: DataFrame,
    key: str,
    label: str | None,
    seed: int,
    quotas: Callable[[dict[str, int]], dict[str, list[int]]],
) -> dict[str, list[str]]:
    """Per class, the hash of the row at each wanted rank (hash order, counted from 1).

    ``quotas`` receives the class sizes and returns the wanted ranks. ``key`` must
    be unique: rows with equal keys always end up on the same side.
    """
    rows = df.select(_class_text(label).alias("cls"), row_hash(key, seed).alias("h"))
    prefix = F.substring("h", 1, PREFIX_DIGITS)
    per_prefix = rows.groupBy("cls", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 rows per class; kept because both the sizes and the cuts need it.
    per_prefix = per_prefix.persist()
    try:
        sizes = {r.cls: r.n for r in per_prefix.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
        wanted = quotas(sizes)
        targets = [
            (c, i, int(rank)) for c, ranks in wanted.items() for i, rank in enumerate(ranks)
            if 0 < rank < sizes[c]
        ]
        cuts = {
            c: [BEFORE_ALL if rank <= 0 else AFTER_ALL for rank in ranks] for c, ranks in wanted.items()
        }
        if not targets:
            return cuts
        running = per_prefix.withColumn("upto", F.sum("n").over(Window.partitionBy("cls").orderBy("prefix")))
        ranks = small_table(df.sparkSession, targets, "cls string, cut int, rank long")
        located = (
            running.join(F.broadcast(ranks), "cls")
            .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
            .select("cls", "prefix", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("nth"), "n")
            .collect()
        )
    finally:
        per_prefix.unpersist()
    digits = PREFIX_DIGITS
    while digits < 32 and max(r.n for r in located) > SORTED_ROWS:
        located, digits = _located_within(df.sparkSession, rows, located, digits, digits + 2), digits + 2
    located = [(r.cls, r.prefix, r.cut, r.nth) for r in located]
    prefix = F.substring("h", 1, digits)
    # As many rows as there are cuts, so both lists are sent along with the job.
    places = small_table(df.sparkSession, located, "cls string, prefix string, cut int, nth long")
    held = small_table(df.sparkSession, sorted({(c, p) for c, p, _, _ in located}), "cls string, prefix string")
    in_order = Window.partitionBy("cls", "prefix").orderBy("h")
    found = (
        rows.withColumn("prefix", prefix)
        .join(F.broadcast(held), ["cls", "prefix"])
        .withColumn("nth", F.row_number().over(in_order))
        .join(F.broadcast(places), ["cls", "prefix", "nth"])
        .select("cls", "cut", "h")
        .collect()
    )
    for r in found:
        cuts[r.cls][r.cut] = r.h
    return cuts


def _located_within(spark, rows: DataFrame, located: list, digits: int, finer: int) -> list:
    """The longer prefixes that hold the cuts of ``located`` (cls, prefix, cut, nth, n)."""
    wanted = small_table(spark, [(r.cls, r.prefix, r.cut, r.nth) for r in located], "cls string, start string, cut int, rank long")
    held = small_table(spark, sorted({(r.cls, r.prefix) for r in located}), "cls string, start string")
    counted = (
        rows.withColumn("start", F.substring("h", 1, digits)).join(F.broadcast(held), ["cls", "start"])
        .groupBy("cls", "start", F.substring("h", 1, finer).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("cls", "start").orderBy("prefix")))
    )
    return (
        counted.join(F.broadcast(wanted), ["cls", "start"])
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("cls", "prefix", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("nth"), "n").collect()
    )


def _cut_column(cuts: dict[str, list[str]], cut: int, label: str | None) -> Column:
    pairs = [F.lit(x) for c, hs in cuts.items() for x in (c, hs[cut])]
    return F.try_element_at(F.create_map(*pairs), _class_text(label))


def proportional_quota(sizes: dict[str, int], total: int) -> dict[str, int]:
    """``total`` rows shared out by class size; what rounding leaves goes to the largest remainders."""
    n = sum(sizes.values())
    quota = {c: total * k // n for c, k in sizes.items()}
    left = total - sum(quota.values())
    by_remainder = sorted(sizes, key=lambda c: (-(total * sizes[c] % n), c))
    for c in by_remainder[:left]:
        quota[c] += 1
    return quota


def split_quotas(sizes: dict[str, int], test_size: float, val_size: float) -> dict[str, list[int]]:
    """Ranks that end the test part and the validation part of each class."""
    n = sum(sizes.values())
    test = proportional_quota(sizes, math.ceil(test_size * n)) if test_size else dict.fromkeys(sizes, 0)
    if not val_size:
        return {c: [test[c], test[c]] for c in sizes}
    rest = {c: k - test[c] for c, k in sizes.items()}
    val = proportional_quota(rest, math.ceil(val_size / (1 - test_size) * sum(rest.values())))
    return {c: [test[c], test[c] + val[c]] for c in sizes}


def split(
    df: DataFrame,
    key: str,
    label: str | None = None,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    output: str = "split",
    among: Column | None = None,
) -> DataFrame:
    """Adds ``train``/``val``/``test``; stratified when a label is given.

    ``among`` restricts which rows count towards the sizes; what the others get has no meaning.
    """
    counted = df if among is None else df.where(among)
    cuts = hash_cuts(counted, key, label, seed, lambda sizes: split_quotas(sizes, test_size, val_size))
    if not cuts:
        return df.withColumn(output, F.lit(None).cast("string"))
    h = row_hash(key, seed)
    part = F.when(h <= _cut_column(cuts, 0, label), "test")
    if val_size:
        part = part.when(h <= _cut_column(cuts, 1, label), "val")
    return df.withColumn(output, part.otherwise("train"))


def folds(df: DataFrame, key: str, label: str | None, k: int = 5, seed: int = 42, output: str = "fold") -> DataFrame:
    """Adds a fold number 0..k-1; within a class the fold sizes differ by at most one."""
    cuts = hash_cuts(
        df, key, label, seed,
        lambda sizes: {c: [math.ceil((i + 1) * n / k) for i in range(k - 1)] for c, n in sizes.items()},
    )
    if not cuts or k < 2:
        return df.withColumn(output, F.lit(0))
    h = row_hash(key, seed)
    passed = [(h > _cut_column(cuts, i, label)).cast("int") for i in range(k - 1)]
    return df.withColumn(output, sum(passed[1:], passed[0]))


def sample(df: DataFrame, key: str, fraction: float | None, seed: int = 42, label: str | None = None) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows (per class when a label is given)."""
    if not fraction or not 0 < fraction < 1:
        return df
    return _first_rows(df, key, label, seed, lambda sizes: {c: [round(fraction * n)] for c, n in sizes.items()})


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class reduced to the size of the smallest one."""
    return _first_rows(df, key, label, seed, lambda sizes: {c: [min(sizes.values())] for c in sizes})


def _first_rows(df, key, label, seed, quotas) -> DataFrame:
    cuts = hash_cuts(df, key, label, seed, quotas)
    return df.where(row_hash(key, seed) <= _cut_column(cuts, 0, label)) if cuts else df
