"""Passages that occur before: hashes of runs of consecutive sentences, joined over the whole corpus."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts
from tidewatch.llm.registry import query, table
from tidewatch.session import cut_lineage

#: A run starts or ends at any sentence and takes the fewest sentences that reach both bounds.
LEAST_SENTENCES, LEAST_WORDS = 2, 15
# Marks that end a sentence, and letters of scripts written without spaces.
ENDS = ".!?\n。！？｡؟।॥"
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: A sentence of more words than this is cut on, after each word where the hash of it and the word before is divisible by ``CUT_EVERY``.
LONG_SENTENCE, CUT_EVERY = 24, 8
_SENTENCE = re.compile(f"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+")
_WORD = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")


def n_words(text: str) -> int:
    """Words between white space; of scripts without spaces each letter is one."""
    return len(text.split()) if text.isascii() else len(_WORD.findall(text))


def sentences(text: str | None) -> list[str]:
    """A text cut after each run of sentence ends and line ends; the pieces together are the text.

    Long sentences are cut on at places that depend on the two words there only, in small letters. A passage inside one is therefore cut alike wherever it
    stands, and equal sentences are always cut alike.
    """
    out = []
    for sentence in _SENTENCE.findall(text or ""):
        if n_words(sentence) <= LONG_SENTENCE:
            out.append(sentence)
            continue
        before, start, due = "", 0, False
        for word in _WORD.finditer(sentence):
            if due:
                out.append(sentence[start:word.start()])
                start = word.start()
            now = word[0].lower()
            due = xxhash.xxh3_64_intdigest(f"{before} {now}".encode("utf-8", "surrogatepass")) % CUT_EVERY == 0
            before = now
        out.append(sentence[start:])
    return out


def runs(text: str | None, least_sentences: int, least_words: int, ends: bool = False) -> list[tuple[bytes, int, int]]:
    """(digest, first sentence, last sentence) of every run. Words are compared in small letters, whatever white space is between them.

    Sentences without words are part of the run around them, but no run starts or ends with one. With ``ends`` the shortest run that ends
    at a sentence is one too, so the runs inside a passage that reaches the bounds cover all of it; else only the shortest from each start.
    """
    pieces = [(i, words) for i, words in enumerate(s.lower().split() for s in sentences(text)) if words]
    lines = [" ".join(words).encode("utf-8", "surrogatepass") for _, words in pieces]
    sizes = [len(words) if line.isascii() else n_words(line.decode("utf-8", "surrogatepass")) for (_, words), line in zip(pieces, lines)]
    digest = lambda a, b: (xxhash.xxh3_128_digest(b"\n".join(lines[a:b + 1])), pieces[a][0], pieces[b][0])
    out, closed, end, held = [], set(), 0, 0
    for start in range(len(pieces)):
        while end < len(pieces) and (held < least_words or end - start < least_sentences):
            held += sizes[end]
            end += 1
        if held < least_words or end - start < least_sentences:
            break
        out.append(digest(start, end - 1))
        closed.add(end - 1)
        held -= sizes[start]
    start, held = 0, 0
    for end in range(len(pieces) if ends else 0):
        held += sizes[end]
        while end - start >= least_sentences and held - sizes[start] >= least_words:
            held -= sizes[start]
            start += 1
        # Where a run from a start ends, the shortest run to that end is among them.
        if held >= least_words and end - start + 1 >= least_sentences and end not in closed:
            out.append(digest(start, end))
    return out


def later_spans(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, ends: bool = False) -> DataFrame:
    """(doc_id, tie, spans): for each document the (first, last) sentences of its runs that occur before.

    The first occurrence of a run is the one with the smallest (doc_id, hash of the text, place), null ids before all others. Counts and first
    places are summed before the shuffle, so a run that occurs in very many documents is one row per task. Its occurrences are joined to a stored
    table with one row per run, so that Spark can split them over tasks.
    """

    def make():
        def compute(texts):
            found = [runs(t, least_sentences, least_words, ends) for t in texts]
            return [[[{"h": int.from_bytes(d[:8], "little", signed=True), "g": int.from_bytes(d[8:], "little", signed=True), "i": a, "j": b} for d, a, b in f]
                     for f in found]]
        return compute

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    spans = map_texts(rows, ["doc_id", "tie"], "text", [("runs", "array<struct<h:bigint,g:bigint,i:int,j:int>>")], make)
    spans = cut_lineage(spans.select("doc_id", "tie", F.inline("runs")))
    place = F.struct("doc_id", "tie", "i")
    repeated = cut_lineage(spans.groupBy("h", "g").count().where("count > 1").select("h", "g"))
    found = cut_lineage(spans.join(repeated, ["h", "g"]))
    firsts = cut_lineage(found.groupBy("h", "g").agg(F.min(place).alias("first")))
    later = found.join(firsts, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("i", "j")).alias("spans"))


def without_repeats(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, ends: bool = False) -> DataFrame:
    """doc_id, text, n_sentences, n_removed and removed (first and last sentence of each stretch) of every row of (doc_id, text).

    A sentence goes if any run that covers it occurs before, in another document or earlier in its own; with ``ends`` that is any sequence of
    sentences that reaches the bounds. Equal rows (same id and text) count as one document and are treated alike. A null text stays null.
    """
    spans = later_spans(docs, least_sentences, least_words, ends).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "spans")
    rows = docs.select("doc_id", "text").join(
        spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tie")), "left").select("doc_id", "text", "spans")
    packed = rows.select("doc_id", F.struct("text", "spans").alias("both"))

    def make():
        def compute(values):
            texts, sizes, counts, stretches = [], [], [], []
            for value in values:
                text, covered = value["text"], value["spans"] or []
                pieces = sentences(text)
                gone, reach, found = [False] * len(pieces), -1, []
                for i, j in sorted((s["i"], s["j"]) for s in covered):
                    if i <= reach + 1 and found:
                        found[-1]["last"] = max(found[-1]["last"], j)
                    else:
                        found.append({"first": i, "last": j})
                    reach = found[-1]["last"]
                for stretch in found:
                    for k in range(stretch["first"], stretch["last"] + 1):
                        gone[k] = True
                texts.append(text if text is None else "".join(p for p, g in zip(pieces, gone) if not g))
                sizes.append(len(pieces))
                counts.append(sum(gone))
                stretches.append(found)
            return [texts, sizes, counts, stretches]
        return compute

    return map_texts(packed, ["doc_id"], "both", [
        ("text", "string"), ("n_sentences", "int"), ("n_removed", "int"), ("removed", "array<struct<first:int,last:int>>")], make)


@query("op8_substring_dedup")
def op8_substring_dedup(spark, folder):
    """Every document without the sentences of passages that occur before; see :func:`without_repeats`."""
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text"), ends=True)
