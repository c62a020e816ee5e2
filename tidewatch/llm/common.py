"""Helpers shared by the operators: words, columns by Arrow, connected components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema  # noqa: F401

from tidewatch.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words between ASCII white space, in lists of bounded length, so that a very long text is never split whole."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, str]],
              make: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """``keep`` columns as they are, beside new columns computed from ``text``.

    ``make`` runs once per task and returns a function from a list of texts to one list of values per field.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields])
    arrow = to_arrow_schema(schema)
    kinds = [arrow.field(len(keep) + i).type for i in range(len(fields))]

    def run(batches):
        compute = make()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start in range(0, max(table.num_rows, 1), 500):
                part = table.slice(start, 500)
                values = compute(part.column(text).to_pylist())
                columns = [part.column(c).combine_chunks() for c in keep]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in columns]
                columns += [pa.array(v, k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                    [pa.field(f.name, c.type) for f, c in zip(arrow, columns)]))

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Large-star and small-star rounds; each replaces a node's larger neighbours, then its smaller ones, by links to the
    smallest neighbour. Only sums and joins by node are used, so a node with very many links is split like any other
    skewed key. A round's links are written to the shared folder.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, state = cut_lineage(links), None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = seen
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.where("u <> v").distinct())


def text_blocks(text: str, size: int = BLOCK_BYTES) -> Iterator[str]:
    """A text in pieces of about ``size`` characters that end before white space."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end
