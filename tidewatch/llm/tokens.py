"""Training order on disk: token ids in fixed-size sequences, permuted by a keyed Feistel network, in fixed-stride binary shards."""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import uuid
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage, scratch_path

#: Byte-level vocabulary as ranks; the id after the last rank is free and ends a document.
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How that vocabulary splits text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 256
SHARD_BYTES = 32_000_000
KEY = 0x5EED_2026
ROUNDS = 6
#: Records that a task packs at a time, and that are written or read at a time.
HELD, WRITTEN = 32_768, 2_000
#: Texts that a task encodes, or cuts into records, at a time; and how hard stored ids and packed records are compressed.
ROWS, ZSTD = 500, 9
#: So many of the most frequent ids take one byte where ids are stored or travel. Their order is counted on the first characters of the first rows
#: of each task and of every so many further ones; it decides how many bytes an id takes and nothing else.
NEAR, FIRST_ROWS, EVERY_ROWS, COUNTED_CHARS = 192, 64, 256, 2_000
#: Set in the count of a record whose document has no id.
NO_ID = 1 << 31
#: Before the ids: slot, doc_id, chunk and count; after them two zero bytes.
HEADER = [("slot", "<i8"), ("doc_id", "<i8"), ("chunk", "<u4"), ("count", "<u4")]
END = "\0\0"
#: What travels of a record beside its ids: its place in the shard and the numbers after the slot.
TRAVELLING = np.dtype([("at", "<u4"), *HEADER[1:]])


def record_type(length: int) -> np.dtype:
    """How a shard's records lie in the file: ``np.memmap(path, record_type(length))`` reads any of them by position."""
    return np.dtype([*HEADER, ("ids", "<u2", (length,)), ("end", "<u2")])


def _halves(size: int) -> int:
    return max(1, (max(size - 1, 1).bit_length() + 1) // 2)


def _mix(values: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (values + salt) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & mask


def permuted(places: np.ndarray, size: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A permutation of 0 .. size-1 applied to ``places`` (or undone): a Feistel network on the next even number of bits, walked
    on from a place beyond ``size`` until it falls inside."""
    bits = _halves(size)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    out = places.astype(np.uint64)
    walk = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walk):
            left, right = out[walk] >> shift, out[walk] & mask
            for r in order:
                if back:
                    left, right = right ^ _mix(left, key, r, mask), left
                else:
                    left, right = right, left ^ _mix(right, key, r, mask)
            out[walk] = (left << shift) | right
            walk = walk[out[walk] >= np.uint64(size)]
    return out.astype(np.int64)


@functools.lru_cache(maxsize=2)
def _encoding(content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r"(?<=\S) (?=\S)")


def encoded(encoding: tiktoken.Encoding, text: str, block: int = 1 << 20) -> array:
    """Ids of a whole text; a very long one is cut before single spaces, where the split pattern always cuts."""
    out, start = array("H"), 0
    while start < len(text):
        found = _CUT.search(text, start + block) if start + block < len(text) else None
        end = found.start() if found else len(text)
        out.extend(encoding.encode_ordinary(text[start:end]))
        start = end
    return out


def _frequent_first(docs: DataFrame, sent, last_id: int) -> np.ndarray:
    """All ids, the frequent ones first, by their counts in some texts; ids without a count follow by number."""

    def run(batches):
        encoding, n = _encoding(sent.value), np.zeros(last_id + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += np.bincount(encoded(encoding, text), minlength=last_id + 1)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["id", "n"])

    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    heads = docs.select("text", place.alias("place")).where(f"(place < {FIRST_ROWS} OR place % {EVERY_ROWS} = 0) AND text <> ''")
    counted = heads.select(F.substring("text", 1, COUNTED_CHARS)).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(last_id + 1, np.int64)
    n[[r.id for r in counted]] = [r.n for r in counted]
    n[last_id] += 1
    return np.argsort(-n, kind="stable").astype("<u2")


def _bytes_of(order: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From ids to (leads, tails, sizes): a byte for each id, the further bytes of the less frequent ones, and how many those are for each id.

    The place of an id in ``order`` is its lead if below ``NEAR``. Leads up to 254 give the high part of the place and the tail is its low byte;
    after lead 255 the tail is the low byte and the high part.
    """
    lead, low, high = (np.zeros(1 << 16, np.uint8) for _ in range(3))
    places = np.arange(len(order))
    far = np.maximum(places - NEAR, 0)
    lead[order] = np.where(places < NEAR, places, np.minimum(NEAR + (far >> 8), 255))
    low[order], high[order] = far & 255, far >> 8
    n_more = (lead >= NEAR).astype(np.uint8) + (lead == 255)

    def run(ids):
        sizes = n_more[ids]
        less = ids[sizes > 0]
        return lead[ids], np.stack([low[less], high[less]], 1)[n_more[less][:, None] > np.arange(2)], sizes

    return run


def _ids_of(order: np.ndarray, leads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The ids that :func:`_bytes_of` turned into these bytes."""
    ids = np.resize(order, 256)[leads]
    at = np.flatnonzero(leads >= NEAR)
    two = leads[at] == 255
    starts = np.cumsum(1 + two) - (1 + two)
    high = leads[at].astype(np.int64) - NEAR
    high[two] = tails[starts[two] + 1]
    ids[at] = order[NEAR + (high << 8) + tails[starts]]
    return ids


def _likeness(leads: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean lead of each piece: pieces in one language have similar ones, and are compressed better side by side."""
    return np.add.reduceat(leads, starts, dtype=np.int64) / sizes


def _binaries(content: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive pieces of some bytes as a binary column."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(content))])


def _content(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]


def _stored_ids(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, np.ndarray]:
    """A stored table (pid, pos, doc_id, tie, n_ids, leads, tails): the ids of each text and one closing id, by task and place in the task; and the order
    of ids that their bytes refer to.

    Texts are encoded once; whatever follows reads this table. It is bucketed by ``pid``, so that joining by it moves no ids.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    if len(content) > 50_000_000:
        raise ValueError("a vocabulary of this size is not sent to every task")
    last_id = len(content.splitlines())
    if last_id >= 1 << 16:
        raise ValueError("ids are written in two bytes")
    sent = spark.sparkContext.broadcast(content)
    order = _frequent_first(docs, sent, last_id)
    ordered = spark.sparkContext.broadcast(order)

    def run(batches):
        encoding, bytes_of, pid, pos = _encoding(sent.value), _bytes_of(ordered.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [encoded(encoding, t or "") for t in part.column("text").to_pylist()]
                for ids in found:
                    ids.append(last_id)
                n, sizes = part.num_rows, np.fromiter(map(len, found), np.int64, len(found))
                leads, tails, more = bytes_of(np.frombuffer(b"".join(found), "<u2"))
                starts = np.cumsum(sizes) - sizes
                more = np.add.reduceat(more, starts, dtype=np.int64)
                places = np.arange(pos, pos + n)
                pos += n
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, pid, np.int32)), pa.array(places), part.column("doc_id"), part.column("tie"), pa.array(sizes),
                     _binaries(leads, sizes), _binaries(tails, more)],
                    ["pid", "pos", "doc_id", "tie", "n_ids", "leads", "tails"])
                yield whole.take(pa.array(np.argsort(_likeness(leads, starts, sizes), kind="stable")))

    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"))
    stored = rows.mapInArrow(run, "pid int, pos long, doc_id long, tie long, n_ids long, leads binary, tails binary")
    name, buckets = f"tidewatch_ids_{uuid.uuid4().hex}", max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored.write.bucketBy(buckets, "pid").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(ZSTD)).option(
        "path", scratch_path(spark, "token-ids")).saveAsTable(name)
    return spark.table(name), order


def _numbered(stored: DataFrame, length: int) -> tuple[DataFrame, int]:
    """(pid, firsts) and the number of all sequences: the dense number of the first sequence of each row of a task, by place.

    Documents are numbered by (doc_id, hash of the text), null ids last, over value ranges; equal rows follow each other by task and place, which
    spreads many of them over ranges. A range adds up its own counts while it is stored; what lies before it is a number a range.
    """
    at = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie"), F.col("pid"), F.col("pos")]
    rows = stored.select("pid", "pos", "doc_id", "tie", F.ceil(F.col("n_ids") / length).alias("n"))

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid"), batch.column("pos"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), batch.column("n")],
                ["pid", "pos", "part", "before", "n"])

    ranged = rows.repartitionByRange(*at).sortWithinPartitions(*at).select("pid", "pos", "n")
    ranged = cut_lineage(ranged.mapInArrow(run, "pid int, pos long, part int, before long, n long"))
    totals = ranged.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    # One row per range.
    ends = cut_lineage(totals.withColumn("end", F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("part"))))
    size = ends.agg(F.max("end")).first()[0] or 0
    firsts = ranged.join(ends, "part").select("pid", "pos", (F.col("end") - F.col("total") + F.col("before")).alias("first"))
    return firsts.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "first"))), lambda x: x["first"]).alias("firsts")), size


def _packs(rows: DataFrame, size: int, per_shard: int, length: int, key: int, ordered) -> DataFrame:
    """(shard, heads, leads, tails): records of (doc_id, leads, tails, n_ids, first) without what fills them up, packed by shard and compressed, a bounded
    number of them at a time."""
    kind = record_type(length)

    def finished(part):
        """The records of some rows, all at once, and their likeness."""
        leads = _content(part.column("leads"))
        ids = _ids_of(ordered.value, leads, _content(part.column("tails")))
        sizes = part.column("n_ids").to_numpy()
        counts = -(-sizes // length)
        starts = np.cumsum(counts) - counts
        records = np.zeros(int(counts.sum()), kind)
        whole, first_ids = np.zeros(len(records) * length, "<u2"), np.cumsum(sizes) - sizes
        whole[np.repeat(starts * length - first_ids, sizes) + np.arange(len(ids))] = ids
        chunks = np.arange(len(records)) - np.repeat(starts, counts)
        unknown = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        docs = part.column("doc_id").fill_null(0).to_numpy()
        firsts = part.column("first").to_numpy()
        records["slot"], records["chunk"], records["doc_id"] = permuted(np.repeat(firsts, counts) + chunks, size, key), chunks, np.repeat(docs, counts)
        n_ids = np.minimum(np.repeat(sizes, counts) - length * chunks, length)
        records["count"] = n_ids + np.where(np.repeat(unknown, counts), NO_ID, 0)
        records["ids"] = whole.reshape(-1, length)
        return records, _likeness(leads, np.repeat(first_ids, counts) + length * chunks, n_ids)

    def run(batches):
        press, bytes_of, held, n = zstandard.ZstdCompressor(level=ZSTD), _bytes_of(ordered.value), [], 0

        def packed():
            records, like = map(np.concatenate, zip(*held))
            records = records[np.lexsort([like, records["slot"] // per_shard])]
            which = records["slot"] // per_shard
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1])
            heads = np.empty(len(records), TRAVELLING)
            heads["at"] = records["slot"] - which * per_shard
            for name, _ in HEADER[1:]:
                heads[name] = records[name]
            sizes = (records["count"] & (NO_ID - 1)).astype(np.int64)
            leads, tails, more = bytes_of(records["ids"][np.arange(length) < sizes[:, None]])
            more = np.add.reduceat(more, np.cumsum(sizes) - sizes, dtype=np.int64)

            def pressed(content, sizes):
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, cuts))])
                return pa.array([press.compress(np.ascontiguousarray(content[a:b]).tobytes()) for a, b in zip(ends, ends[1:])], pa.binary())

            return pa.RecordBatch.from_arrays(
                [pa.array(which[cuts].astype(np.int32)), pressed(heads, np.ones(len(heads), np.int64)), pressed(leads, sizes), pressed(tails, more)],
                ["shard", "heads", "leads", "tails"])

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, ROWS)
                start += ROWS
                held.append(finished(part))
                n += len(held[-1][0])
                if n >= HELD:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    return rows.select("doc_id", "leads", "tails", "n_ids", "first").mapInArrow(run, "shard int, heads binary, leads binary, tails binary")


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> int:
    """Writes the sequences of (doc_id, text) in training order below ``path``; returns how many records a shard has.

    A document's ids and one closing id are cut into sequences of ``length`` ids, the last one filled up with closing ids. All sequences are
    numbered densely, 0 to N - 1; the keyed permutation of that number is the sequence's slot. Slot ``s`` is record ``s % per_shard`` of shard
    ``s // per_shard``: all shards but the last are equal, and a reader resumes by arithmetic. So the order depends on nothing but the rows and the
    key, and repeated rows are spread like any others. Null ids come after all others before the permutation; null and empty texts are one
    sequence without text. An empty table writes no record.

    Ids are stored and travel in one to three bytes, frequent ids in one, compressed; what fills up a record does not travel. Each range of slots is
    put in place by one task, which fails if a slot is missing or taken twice. It writes through Spark's own writer and commit, so a lost task leaves
    nothing behind and any store will do. A task holds one shard.
    """
    kind, per_shard = record_type(length), max(1, shard_bytes // record_type(length).itemsize)
    stored, order = _stored_ids(docs, vocabulary)
    firsts, size = _numbered(stored, length)
    if not size:
        docs.sparkSession.createDataFrame([], "value string").write.text(path)
        return per_shard
    placed = stored.join(firsts.hint("shuffle_hash"), "pid").select(
        "doc_id", "leads", "tails", "n_ids", F.get("firsts", F.col("pos").cast("int")).alias("first"))
    shards = -(-size // per_shard)
    ordered, closing = docs.sparkSession.sparkContext.broadcast(order), len(order) - 1

    def settle(batches):
        press, whole, shard, seen, held, n = zstandard.ZstdDecompressor(), None, None, 0, [], 0

        def put():
            heads, leads, tails = (np.frombuffer(b"".join(x), k) for x, k in zip(zip(*held), (TRAVELLING, np.uint8, np.uint8)))
            ids = np.full((len(heads), length), closing, "<u2")
            ids[np.arange(length) < (heads["count"] & (NO_ID - 1))[:, None]] = _ids_of(ordered.value, leads, tails)
            whole["ids"][heads["at"]], taken[heads["at"]] = ids, True
            for name, _ in HEADER[1:]:
                whole[name][heads["at"]] = heads[name]

        for batch in batches:
            for number, *packed in zip(*(batch.column(c) for c in ("shard", "heads", "leads", "tails"))):
                if whole is None:
                    shard = number.as_py()
                    whole = np.zeros(min(per_shard, size - shard * per_shard), kind)
                    whole["slot"], taken = shard * per_shard + np.arange(len(whole)), np.zeros(len(whole), bool)
                held.append([press.decompress(x.as_buffer()) for x in packed])
                n += len(held[-1][0]) // TRAVELLING.itemsize
                if n >= WRITTEN:
                    put()
                    held, seen, n = [], seen + n, 0
        if n:
            put()
            seen += n
        if whole is not None:
            if seen != len(whole) or not taken.all():
                raise ValueError(f"shard {shard}: {seen} records for {len(whole)} slots")
            for start in range(0, len(whole), WRITTEN):
                yield pa.RecordBatch.from_arrays([pa.array([whole[start: start + WRITTEN].tobytes()[: -len(END)]], pa.binary())], ["value"])

    ranged = _packs(placed, size, per_shard, length, key, ordered).repartitionById(shards, "shard")
    ranged.mapInArrow(settle, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).text(path)
    return per_shard


def shards(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """One row per shard: shard, path and sequences, from the files' sizes alone. A shard's first slot is its number times the records of a full shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("shard"), "path", F.expr(f"length div {record_type(length).itemsize}").alias("sequences"))


def read_shards(spark: SparkSession, path: str, per_shard: int, length: int = LENGTH) -> DataFrame:
    """(slot, shard, doc_id, chunk, count, ids) of every sequence, read back by ranges of records: no task holds a whole shard."""
    kind = record_type(length)

    def joined(records):
        while part := list(itertools.islice(records, WRITTEN)):
            yield (bytearray(b"".join(part)),)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                part = np.frombuffer(content.as_buffer(), kind)
                ids = np.ascontiguousarray(part["ids"])
                fixed = pa.Array.from_buffers(pa.binary(2 * length), len(part), [None, pa.py_buffer(ids)]).cast(pa.binary())
                unknown = part["count"] >= NO_ID
                yield pa.RecordBatch.from_arrays([
                    pa.array(part["slot"].astype(np.int64)), pa.array((part["slot"] // per_shard).astype(np.int32)),
                    pa.array(part["doc_id"].astype(np.int64), mask=unknown), pa.array(part["chunk"].astype(np.int64)),
                    pa.array((part["count"] & (NO_ID - 1)).astype(np.int32)), fixed,
                ], ["slot", "shard", "doc_id", "chunk", "count", "ids"])

    schema = "slot long, shard int, doc_id long, chunk long, count int, ids binary"
    if not spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path").head(1):
        return spark.createDataFrame([], schema)
    records = spark.sparkContext.binaryRecords(f"{path}/part-*", kind.itemsize)
    return spark.createDataFrame(records.mapPartitions(joined), "content binary", verifySchema=False).mapInArrow(run, schema)


def materialise(docs: DataFrame, name: str) -> DataFrame:
    """Writes the shards into the shared folder and returns slot, shard, doc_id, chunk, count and a checksum of the ids of each sequence."""
    spark = docs.sparkSession
    path = scratch_path(spark, name)
    return read_shards(spark, path, write_shards(docs, path)).select(
        "slot", "shard", "doc_id", "chunk", "count", F.crc32("ids").alias("checksum"))


@query("op3_tokens")
def op3_tokens(spark, folder):
    """Every sequence of every document by its slot in the training order; see :func:`write_shards` for nulls, ties and repeats."""
    return materialise(table(spark, folder, "documents").select("doc_id", "text"), "shards")
