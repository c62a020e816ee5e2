"""Short license notices: exact phrases, and notices within a number of edits found through exact seeds."""

from __future__ import annotations

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_texts, word_blocks
from tidewatch.llm.registry import query, table

#: Exact phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices searched with edits, their labels, and the words that name the license: those must stand unchanged, edits fall on the others.
NOTICES = [
    ("released under the mit license", "mit", "mit"),
    ("licensed under the apache license version 2", "apache-2", "apache 2"),
    ("licensed under cc by nc", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa", "cc-by-sa", "cc by sa"),
    ("licensed under cc by nd", "cc-by-nd", "cc by nd"),
    ("creative commons attribution noncommercial", "cc-by-nc", "creative commons noncommercial"),
    ("gnu general public license version 3", "gpl-3", "gnu general public 3"),
    ("gnu general public license version 2", "gpl-2", "gnu general public 2"),
    ("gnu lesser general public license", "lgpl", "gnu lesser general public"),
    ("mozilla public license version 2", "mpl-2", "mozilla public 2"),
    ("redistribution and use in source and binary forms", "bsd", "redistribution binary"),
    ("this is free and unencumbered software", "unlicense", "unencumbered"),
]
ERROR_RATE = 0.1
#: A word is a run of these bytes once A-Z are small: digits, a-z and whatever is not ASCII.
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())


def normalized(text: str | None) -> bytes:
    """The words of a whole text with one space between them."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    return b" ".join(b" ".join(words) for words in word_blocks(data) if words)


def exact_places(words: bytes, phrases) -> list[tuple[int, str]]:
    """(position, label) of every place where the words of a phrase stand one after the other."""
    padded, out = b" " + words + b" ", []
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at = padded.find(wanted)
        while at >= 0:
            out.append((at, label))
            at = padded.find(wanted, at + 1)
    return sorted(out)


class FuzzyNotices:
    """Spans within ``int(rate * length)`` edits of a notice that hold its naming words unchanged, as whole words and in order.

    A notice is split into one piece more than its edits, so a span within the edits holds one piece unchanged. All pieces are sought
    in one pass; around each hit the bounded-error match runs on a window that holds any such span.
    """

    def __init__(self, notices=NOTICES, rate: float = ERROR_RATE):
        self.notices, self.pieces = [], ahocorasick.Automaton()
        for number, (notice, label, naming) in enumerate(notices):
            most = int(rate * len(notice))
            self.notices.append((label, naming.split(), len(notice), most, regex.compile(f"(?e)(?:{regex.escape(notice, literal_spaces=True)}){{e<={most}}}")))
            cuts = [len(notice) * i // (most + 1) for i in range(most + 2)]
            for start, end in zip(cuts, cuts[1:]):
                known = self.pieces.get(notice[start:end], ())
                self.pieces.add_word(notice[start:end], (*known, (number, start)))
        self.pieces = _kept_with_length(self.pieces)

    def __call__(self, words: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) by character, in order."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.pieces.iter(words):
            for number, offset in places:
                _, _, size, most, _ = self.notices[number]
                start = end + 1 - length - offset - most
                mine = windows.setdefault(number, [])
                mine.append([max(0, start), start + size + 2 * most])
        out = []
        for number, spans in windows.items():
            label, naming, _, _, pattern = self.notices[number]
            for start, end in _merged(spans):
                for found in pattern.finditer(words, start, min(end, len(words))):
                    if _in_order(naming, _whole_words(words, found.start(), found.end())):
                        out.append((label, found.start(), found.end(), sum(found.fuzzy_counts)))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def _whole_words(words: str, start: int, end: int) -> list[str]:
    """The words that a span touches."""
    after = words.find(" ", end)
    return words[words.rfind(" ", 0, start + 1) + 1: after if after >= 0 else len(words)].split()


def _in_order(wanted: list[str], words: list[str]) -> bool:
    rest = iter(words)
    return all(w in rest for w in wanted)


def _spaces(words: bytes | str) -> np.ndarray:
    """Where the spaces are, by byte or by character: the number of a word is the number of spaces before it."""
    codes = np.frombuffer(words, np.uint8) if isinstance(words, bytes) else np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.flatnonzero(codes == 32)


def _kept_with_length(pieces: ahocorasick.Automaton) -> ahocorasick.Automaton:
    whole = ahocorasick.Automaton()
    for piece, places in pieces.items():
        whole.add_word(piece, (len(piece), places))
    whole.make_automaton()
    return whole


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scan(docs: DataFrame, keep: list[str], text: str = "text", phrases=PHRASES, notices=NOTICES, rate: float = ERROR_RATE) -> DataFrame:
    """``keep``, n_words, ``exact`` (places of phrases) and ``fuzzy`` (spans of notices with their edits), both by word from 0.

    Null and empty texts have no words and empty lists; repeated rows are each answered. Spans may overlap, of one notice or of several, and all
    are returned. ``keep`` must not hold a column named like a result.
    """
    if clash := {"n_words", "exact", "fuzzy"} & set(keep):
        raise ValueError(f"columns named like results: {sorted(clash)}")

    def make():
        fuzzy = FuzzyNotices(notices, rate)

        def compute(texts):
            sizes, exact, spans = [], [], []
            for t in texts:
                words = normalized(t)
                sizes.append(words.count(b" ") + 1 if words else 0)
                places = exact_places(words, phrases)
                at = np.searchsorted(_spaces(words), [p for p, _ in places]) if places else []
                exact.append([{"word": int(w), "label": label} for w, (_, label) in zip(at, places)])
                plain = words.decode("utf-8", "surrogatepass")
                near = fuzzy(plain)
                ends = np.searchsorted(_spaces(plain), [[s, e] for _, s, e, _ in near]) if near else []
                spans.append([{"label": label, "first_word": int(a), "last_word": int(b), "edits": n} for (label, _, _, n), (a, b) in zip(near, ends)])
            return [sizes, exact, spans]

        return compute

    return map_texts(docs, keep, text, [
        ("n_words", "bigint"), ("exact", "array<struct<word:bigint,label:string>>"),
        ("fuzzy", "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>")], make)


@query("op5_license_scan")
def op5_license_scan(spark, folder):
    """One row per document: words, exact places, the labels of both searches, and a score.

    The score is 1 with an exact place, else 0.9 to the number of edits of the closest span, else 0.
    """
    found = scan(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact.word").alias("first_word"), F.array_max("exact.word").alias("last_word"),
        labels(F.col("exact.label")).alias("base_labels"),
        labels(F.concat("exact.label", "fuzzy.label")).alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(F.coalesce(F.pow(F.lit(0.9), F.array_min("fuzzy.edits")), F.lit(0.0))).alias("score"),
        F.col("fuzzy").alias("spans"))
