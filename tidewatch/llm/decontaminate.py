"""Documents that hold a benchmark item within a number of edits: exact pieces locate, bit-parallel edit distance verifies."""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts, word_blocks
from tidewatch.llm.license_scan import _merged
from tidewatch.llm.registry import query, table

#: Edits per character of an item.
ERROR_RATE = 0.06
#: Characters of items that are searched in one pass over the documents; more items mean more passes.
BLOCK_CHARS = 8_000_000


def normalized(text: str | None) -> str:
    """Small letters, one space between words."""
    return b" ".join(b" ".join(words) for words in word_blocks((text or "").lower().encode("utf-8", "surrogatepass")) if words).decode("utf-8", "surrogatepass")


def closest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` with the least edit distance to ``item``; the first such end.

    Myers' bit-parallel rows: the vertical differences of a whole column are two integers of ``len(item)`` bits.
    """
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    holds: dict[str, int] = {}
    for i, c in enumerate(item):
        holds[c] = holds.get(c, 0) | 1 << i
    up, down, distance = full, 0, size
    best, where = size, 0
    for end, c in enumerate(text, 1):
        equal = holds.get(c, 0)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~((equal | down) | plus)) & full, plus & (equal | down)
        if distance < best:
            best, where = distance, end
    return best, where


class Items:
    """Items, each split into one piece more than its edits: a passage within the edits holds one piece unchanged."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items, pieces = [], {}
        for number, (item_id, item) in enumerate(items):
            most = int(rate * len(item))
            self.items.append((item_id, item, most))
            cuts = [len(item) * i // (most + 1) for i in range(most + 2)]
            for start, end in zip(cuts, cuts[1:]):
                pieces.setdefault(item[start:end], []).append((number, start))
        self.pieces = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.pieces.iter(text):
            for number, offset in places:
                _, item, most = self.items[number]
                start = end + 1 - length - offset - most
                windows.setdefault(number, []).append([max(0, start), start + len(item) + 2 * most])
        out = []
        for number, spans in windows.items():
            item_id, item, most = self.items[number]
            distance, end = min((d, s + e) for s, stop in _merged(spans) for d, e in [closest(item, text[s:stop])])
            if distance <= most:
                out.append({"item_id": item_id, "distance": distance, "end": end})
        return out


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], rate: float = ERROR_RATE, text: str = "text") -> DataFrame:
    """``keep`` and item_id, distance and end (in the normalised text), one row for each document and each item it holds.

    Items are the distinct normalised texts of ``benchmark``; null and empty ones match nothing, equal ones count under their smallest id.
    They are a stated query set: read in blocks of bounded size, each block sent to all tasks and searched in all documents.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    items = map_texts(items, ["item_id"], "text", [("words", "string")], lambda: lambda texts: [[normalized(t) for t in texts]])
    items = items.where("words <> ''").groupBy("words").agg(F.min("item_id").alias("item_id"))
    sizes = items.groupBy(F.expr("pmod(xxhash64(words), 4096)").alias("part")).agg(F.sum(F.length("words")).alias("n")).collect()
    blocks, filled = [[]], 0
    for row in sorted(sizes, key=lambda r: r.part):
        if filled and filled + row.n > BLOCK_CHARS:
            blocks, filled = [*blocks, []], 0
        blocks[-1].append(row.part)
        filled += row.n
    result = None
    for parts in blocks:
        chosen = items.where(F.expr("pmod(xxhash64(words), 4096)").isin(parts)) if len(blocks) > 1 else items
        sent = spark.sparkContext.broadcast([(r.item_id, r.words) for r in chosen.orderBy("words").collect()])

        def make(sent=sent):
            if not sent.value:
                return lambda texts: [[[] for _ in texts]]
            find = Items(sent.value, rate)
            return lambda texts: [[find(normalized(t)) for t in texts]]

        found = map_texts(docs, keep, text, [("found", "array<struct<item_id:bigint,distance:int,end:bigint>>")], make)
        found = found.where(F.size("found") > 0)
        result = found if result is None else result.unionByName(found)
    return result.select(*keep, F.explode("found").alias("x")).select(*keep, "x.item_id", "x.distance", "x.end")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    bad = matches(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), benchmark, ["doc_id", "h"], rate)
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left_anti")


@query("op10_decontaminate")
def op10_decontaminate(spark, folder):
    """(doc_id, item_id, distance, end) for every document and benchmark item it holds; clean documents have no row."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return matches(docs, table(spark, folder, "benchmark"), ["doc_id"])
