"""Token counts per document: a broadcast table of frequent pre-token lengths first, worker caches and the encoder for the rest."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BLOCK_BYTES, map_texts
from tidewatch.llm.registry import query, table

#: The model's sign for a space. A pre-token is a run of such signs and all that follows up to the next run.
SPACE = "▁"
_PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
_CUT = re.compile(f"(?<=[^ {SPACE}])(?=[ {SPACE}])")
#: The table holds at most so many pre-tokens of at most so many characters, which bounds the broadcast to some 15 MB.
TABLE, TABLE_CHARS = 1 << 16, 64
#: A task hands on its most frequent pre-tokens, this many; while it reads it remembers at most ``HELD``.
PER_TASK, HELD = 4096, 200_000
#: Pre-tokens in a worker's cache, which starts afresh when it is full.
CACHED = 100_000
LIMIT = 4096


def separable(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether the model's ids of a text are those of its pre-tokens one after the other: no piece reaches over the start of a
    run of spaces, spaces stay as they are, and a text gets one space before it."""
    crossing = re.compile(f"[^{SPACE}]{SPACE}")
    return model.normalize(" a  b ") == f"{SPACE * 2}a{SPACE * 2}b{SPACE}" and not any(
        crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size()))


@functools.lru_cache(maxsize=2)
def _loaded(content: bytes) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    return model, separable(model)


def pretoken_length(model: sentencepiece.SentencePieceProcessor, pretoken: str) -> int:
    """Ids of a pre-token. The model puts a space before what it encodes, so one is taken off; a single space alone would vanish."""
    return len(model.encode(pretoken[1:])) if len(pretoken) > 1 else len(model.encode("a" + pretoken)) - len(model.encode("a"))


def pretokens(text: str, size: int = BLOCK_BYTES):
    """Lists of the pre-tokens of a text, a bounded piece of it at a time; an empty text has none."""
    start, before = 0, SPACE
    while start < len(text):
        found = _CUT.search(text, start + size) if start + size < len(text) else None
        end = found.start() if found else len(text)
        yield _PRETOKEN.findall(before + text[start:end].replace(" ", SPACE))
        start, before = end, ""


class Lengths(dict):
    """Pre-token lengths known in a worker; the encoder answers what is missing. Long pre-tokens are not kept."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__()
        self.model, self.frequent = model, frequent

    def __missing__(self, pretoken: str) -> int:
        n = self.frequent.get(pretoken)
        if n is None:
            n = pretoken_length(self.model, pretoken)
            if len(pretoken) <= TABLE_CHARS:
                if len(self) >= CACHED:
                    self.clear()
                self[pretoken] = n
        return n


_caches: dict[bytes, Lengths] = {}


def _worker_lengths(content: bytes, frequent: dict[str, int]) -> Lengths:
    """The cache of this worker for a model, kept from task to task."""
    key = hashlib.sha256(content).digest()
    if key not in _caches:
        _caches.clear()
        _caches[key] = Lengths(_loaded(content)[0], frequent)
    _caches[key].frequent = frequent
    return _caches[key]


def frequent_pretokens(docs: DataFrame, text: str = "text", most: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of all texts, at most ``most`` of at most ``TABLE_CHARS`` characters.

    Every task counts the pre-tokens it reads and hands on its own most frequent ones; only those are added up by key. Which ones are
    found never changes a count of tokens, only how fast it is made.
    """

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for part in pretokens(value.as_py() or ""):
                    seen.update(part)
                    if len(seen) > HELD:
                        seen = Counter(dict(seen.most_common(HELD // 4)))
        top = [(p, n) for p, n in seen.most_common(PER_TASK) if len(p) <= TABLE_CHARS and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    found = docs.select(text).mapInArrow(count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return [r.pretoken for r in found.orderBy(F.desc("n"), "pretoken").limit(most).collect()]


def token_counts(docs: DataFrame, keep: list[str], model_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``keep`` columns beside n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row, by the model at ``model_path``.

    Counts are those of the encoder on the whole text, without begin or end, nothing cut. Null texts count as empty ones, which have no
    token; rows may repeat and each is answered. No pre-token is shuffled: lengths of frequent ones are broadcast, others are
    encoded where they are met. A model whose ids of a text are not those of its pre-tokens encodes whole texts.
    ``keep`` must not hold a column named like a result.
    """
    if clash := {"n_bytes", "n_tokens", "over_limit"} & set(keep):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    with open(model_path, "rb") as f:
        content = f.read()
    if len(content) > 50_000_000:
        raise ValueError("a model of this size is not sent to every task")
    model, apart = _loaded(content)
    frequent = {p: pretoken_length(model, p) for p in frequent_pretokens(docs, text)} if apart else {}
    sent = docs.sparkSession.sparkContext.broadcast((content, frequent, apart))

    def make():
        content, frequent, apart = sent.value
        if not apart:
            return lambda texts: [[len(ids) for ids in _loaded(content)[0].encode([t or "" for t in texts], num_threads=1)]]
        length = _worker_lengths(content, frequent).__getitem__
        return lambda texts: [[sum(sum(map(length, part)) for part in pretokens(t or "")) for t in texts]]

    bytes_of = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    counted = map_texts(docs.withColumn("n_bytes", bytes_of), [*keep, "n_bytes"], text, [("n_tokens", "bigint")], make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op13_token_counts")
def op13_token_counts(spark, folder):
    """doc_id, n_bytes, n_tokens and over_limit of every document. Null texts are empty; repeated rows are all answered."""
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
