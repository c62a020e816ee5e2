"""Near-duplicate documents by 64-bit SimHash and multi-index hashing."""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, map_texts, word_blocks
from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage

SEED = 42
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: A bucket with more fingerprints than this, or many times the mean, is searched in blocks by tasks of their own.
CROWDED, CROWDED_TIMES_MEAN, BLOCK = 16, 8, 1024


def simhash(text: str | None, size: int) -> int:
    """Signed 64-bit SimHash of the runs of ``size`` words, repeats counted; 0 without words."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = (ends[: len(ends) - size] if size < len(ends) else ends[:0]).tolist()
            runs = [joined[s:e] for s, e in zip([0, *starts], (ends[size - 1:] - 1).tolist())]
            hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8")
            ones += _ones(hashes)
            total += len(hashes)
        carry = words[max(0, len(words) - size + 1):]
    if not total and carry:
        ones, total = _ones(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)), 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """``keep`` and ``fp`` for each row."""
    return map_texts(docs, keep, text, [("fp", "bigint")], lambda: lambda texts: [[simhash(t, size) for t in texts]])


def segments(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball) of each segment: the balls sum to radius - parts + 1, so a pair within the radius is within
    the ball of one segment at least."""
    spare = radius - parts + 1
    if spare < 0 or not 2 <= parts <= 32:
        raise ValueError("2 to 32 segments, and no more than radius + 1")
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    balls = [spare // parts + (i < spare % parts) for i in range(parts)]
    return list(zip([64 - x for x in accumulate(widths)], widths, balls))


def _keys(fps: DataFrame, name: str, cuts, ball: bool) -> DataFrame:
    """One row per fingerprint and key: the segment's number above the segment, with up to ``ball`` bits flipped."""
    rows = []
    for number, (shift, width, most) in enumerate(cuts):
        for flips in (x for n in range((most if ball else 0) + 1) for x in combinations(range(width), n)):
            rows.append(f"struct({number}L << 32 AS tag, {sum(1 << b for b in flips)}L AS flip, {shift} AS shift, {(1 << width) - 1}L AS mask)")
    variants = fps.select(F.col("fp").alias(name), F.explode(F.expr(f"array({', '.join(rows)})")).alias("x"))
    return variants.select(name, F.expr(f"x.tag | ((shiftrightunsigned({name}, x.shift) & x.mask) ^ x.flip)").alias("key"))


def links(fps: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """Links (a, b) that join every pair of distinct fingerprints ``fp`` with at most ``radius`` differing bits, directly
    or through others within the radius.

    Each fingerprint is stored under its segments and looked up under all keys of small Hamming balls around them. A pair
    sharing a key is compared whole. Buckets of common size are joined by key. Crowded ones (many variants of one text) are cut into
    blocks; each pair of blocks is a task's work, and it returns a spanning forest instead of all its pairs.
    """
    cuts = segments(radius, parts)
    index, probes = _keys(fps, "b", cuts, False), _keys(fps, "a", cuts, True)
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes.where(F.col("n") > CROWDED))
    mean = fps.count() / sum(2 ** min(w, 40) for _, w, _ in cuts) * parts
    crowded = sizes.where(F.col("n") > max(CROWDED, CROWDED_TIMES_MEAN * mean))
    near = F.expr(f"bit_count(a ^ b) <= {radius}")
    usual = (probes.join(crowded, "key", "left_anti").join(index, "key")
             .where((F.col("a") < F.col("b")) & near).select("a", "b"))

    stored = index.join(crowded, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    asked = probes.join(crowded.select("key"), "key", "left_semi")
    asked_sizes = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("asked_blocks"))
    asked = asked.join(asked_sizes, "key").join(crowded.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key")
    stored = stored.join(asked_sizes, "key")
    own, other = F.expr("pmod(xxhash64(a), asked_blocks)"), F.expr("pmod(xxhash64(b), blocks)")
    left = asked.select("key", F.col("a").alias("fp"), F.lit(True).alias("asks"), own.alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    right = stored.select("key", F.col("b").alias("fp"), F.lit(False).alias("asks"), F.explode(F.expr("sequence(0, asked_blocks - 1)")).alias("i"), other.alias("j"))

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        a, b = rows["fp"].to_numpy()[asks], rows["fp"].to_numpy()[~asks]
        linked = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= radius
        pairs = _spanning(linked)
        return pd.DataFrame({"a": a[pairs[:, 0]], "b": b[pairs[:, 1]]})

    hot = left.unionByName(right).groupBy("key", "i", "j").applyInPandas(forest, "a long, b long").where("a <> b")
    return usual.union(hot)


def _spanning(linked: np.ndarray) -> np.ndarray:
    """Pairs (row, column) that connect what the matrix connects."""
    new_rows, new_columns, out = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool), []
    for seed in range(linked.shape[0]):
        if not new_rows[seed]:
            continue
        new_rows[seed], front = False, [seed]
        while front:
            row = front.pop()
            columns = np.flatnonzero(linked[row] & new_columns)
            new_columns[columns] = False
            out += [(row, c) for c in columns]
            for c in columns:
                rows = np.flatnonzero(linked[:, c] & new_rows)
                new_rows[rows] = False
                out += [(r, c) for r in rows]
                front += rows.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def groups(prints: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """Adds ``component_id`` to rows (doc_id, fp, ...): the smallest doc_id whose fingerprint can be reached by links.

    Equal fingerprints are folded into one before any search. A null doc_id is never the smallest; a component of null ids only has a null id.
    """
    fps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(fps.select("fp"), radius, parts)).withColumnRenamed("node", "fp")
    firsts = linked.join(fps, "fp").groupBy("root").agg(F.min("first_id").alias("lowest"))
    linked = linked.join(firsts, "root").select("fp", "lowest")
    # Stored, so that the join below is one of two plain shuffles and Spark can split the rows of a fingerprint that very many documents share.
    ids = cut_lineage(fps.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first_id").alias("component_id")))
    return prints.join(ids, "fp")


def one_per_group(docs: DataFrame, size: int = 3, radius: int = 3, parts: int = 2) -> DataFrame:
    """The rows of ``docs`` that have the smallest (doc_id, hash of the text) of their component; one row of equal ones. Null ids are the largest."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    prints = cut_lineage(fingerprints(rows, ["doc_id", "tie"], size=size))
    fps = cut_lineage(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")).alias("first")))
    linked = components(links(fps.select("fp"), radius, parts)).withColumnRenamed("node", "fp")
    kept = fps.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("__id"), F.col("first.tie").alias("__tie")).distinct()
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    stay = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (tie == F.col("__tie")), "left_semi")
    return stay.withColumn("__tie", tie).dropDuplicates(["doc_id", "__tie"]).drop("__tie")


@query("op1_simhash")
def op1_simhash(spark, folder):
    """doc_id, fingerprint and component of every document, by three-word shingles and three bits.

    Null and empty texts have the fingerprint zero and link with each other; equal rows are all returned.
    """
    prints = cut_lineage(fingerprints(table(spark, folder, "documents"), ["doc_id"]))
    return groups(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
