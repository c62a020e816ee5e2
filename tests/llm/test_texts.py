"""Fuzzy notices, benchmark items, repeated passages and URL rules against brute force."""

import collections
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, license_scan, substrings, url_filter

from .conftest import EDGE, LONG


def changed(text, edits, pick):
    letters = list(text)
    for _ in range(edits):
        i, kind = pick.randrange(len(letters)), pick.randint(0, 2)
        if kind == 0:
            letters[i] = pick.choice("abcdef ")
        elif kind == 1:
            letters.insert(i, pick.choice("abc "))
        elif len(letters) > 1:
            del letters[i]
    return "".join(letters)


def test_fuzzy_notices_equal_a_search_of_the_whole_text():
    pick, find = random.Random(3), license_scan.FuzzyNotices()
    for _ in range(300):
        parts = []
        for _ in range(pick.randint(0, 4)):
            parts += ["".join(pick.choice("the license underaby nc") for _ in range(pick.randint(0, 60))), changed(pick.choice(license_scan.NOTICES)[0], pick.randint(0, 6), pick)]
        words = " ".join(" ".join(parts).split())
        expected = set()
        for notice, label, naming in license_scan.NOTICES:
            for m in regex.finditer(f"(?e)(?:{notice}){{e<={int(0.1 * len(notice))}}}", words):
                inside = iter((words[: m.start()].rpartition(" ")[2] + m.group() + words[m.end():].partition(" ")[0]).split())
                if all(w in inside for w in naming.split()):
                    expected.add(label)
        assert {s[0] for s in find(words)} == expected


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("text,labels", [
    ("licensed under cc by sa", {"cc-by-sa"}), ("licensed under cc by nd", {"cc-by-nd"}), ("released under the bsd license", set()),
    ("released under the isc license", set()), ("released under the zlib license", set()), ("gnu general public license version 2", {"gpl-2"}),
    ("mozilla public license version 1", set()), ("licensed under the apache license version 1", set()), ("relaesed under the mit licence", {"mit"}),
    ("gnu generel public license version 3", set()), ("gnu general public licence version 3", {"gpl-3"}), ("gnu general public license version 33", set()),
])
def test_edits_never_fall_on_the_name_of_a_license(text, labels):
    assert {found[0] for found in license_scan.FuzzyNotices()("some words " + text + " and more")} == labels


def test_many_places_are_counted_in_linear_time(spark):
    import time

    text = "under the mit license " * 400_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    words = license_scan.normalized(text)
    places = license_scan.exact_places(words, license_scan.PHRASES)
    at = license_scan._spaces(words).searchsorted([p for p, _ in places])
    assert len(places) == 400_000 and time.time() - started < 10 and at.tolist() == list(range(0, 1_600_000, 4))
    short = license_scan.scan(df.selectExpr("doc_id", "substr(text, 1, 2200) AS text"), ["doc_id"]).first()
    assert [p.word for p in short.exact] == list(range(0, 400, 4))


def test_exact_places_and_words(spark, edge, nothing):
    pick = random.Random(5)
    texts = ["".join(pick.choice(["The ", "MIT", " mit ", "License", " license", "-", "cc by", " by-", "nc", "CC-BY-NC", "apache license, version 2", "é", "0"])
                     for _ in range(pick.randint(0, 30))) for _ in range(200)] + [None, ""]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"]).collect()
    for r in got:
        words = words_of(texts[r.doc_id])
        places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(words) and sorted((e.word, e.label) for e in r.exact) == sorted(places)
    edges = {r.doc_id: r for r in license_scan.scan(edge, ["doc_id"]).collect()}
    assert edges[3].n_words == 0 and edges[3].fuzzy == [] and edges[6].n_words == len(words_of(LONG)) and len(edges) < len(EDGE)
    assert license_scan.scan(nothing, ["doc_id"]).count() == 0


def test_the_mit_phrase_starts_at_under(spark, tmp_path):
    docs = [(1, "Code under the MIT License."), (2, "Code has the MIT License."), (3, "x, Under the-MIT license; and the MIT license")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.op5_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 1, "mit"), 2: (0, None, None, ""), 3: (1, 1, 1, "mit")}


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    pick = random.Random(3)
    for _ in range(300):
        item, text = ("".join(pick.choice("abcé ") for _ in range(pick.randint(*n))) for n in ((1, 20), (0, 40)))
        assert decontaminate.closest(item, text) == distance(item, text)


def test_items_equal_all_distances(spark, monkeypatch):
    pick = random.Random(9)
    items = [(i, decontaminate.normalized("".join(pick.choice("abcdefgh ") for _ in range(pick.randint(5, 120)))) or "x") for i in range(30)]
    filler = lambda: "".join(pick.choice("abcdefgh ") for _ in range(50))
    docs = [(d, f"{filler()} {changed(pick.choice(items)[1], pick.randint(0, 8), pick)} {filler()}") for d in range(120)]
    expected = {(d, i, n) for d, t in docs for i, item in items for n in [distance(item, decontaminate.normalized(t))[0]] if n <= int(0.06 * len(item))}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(*frames, ["doc_id"]).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    blocks = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(*frames, ["doc_id"]).collect()}
    assert whole == blocks == expected and expected


def test_leaks_at_the_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Number  w5 w6 W7"), (4, "number w5 w6 w7"), (None, "text WITHOUT an id")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(edge, items, ["doc_id"]).collect()} == {(None, None)}
    long = spark.createDataFrame([(3, "W5 w6  W7 w8")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(edge, long, ["doc_id"]).collect()] == [(6, 3)]
    assert decontaminate.clean(edge, items).count() == len(EDGE) - 1 and decontaminate.clean(edge, items).columns == edge.columns
    assert decontaminate.clean(edge, nothing.select(F.col("doc_id").alias("item_id"), "text")).count() == len(EDGE)
    assert decontaminate.matches(nothing, items, ["doc_id"]).count() == 0


def all_runs(text, least_words):
    pieces = [(i, s.lower().split()) for i, s in enumerate(substrings.sentences(text)) if s.split()]
    for a in range(len(pieces)):
        for b in range(a + 2, len(pieces) + 1):
            if sum(len(w) for _, w in pieces[a:b]) >= least_words:
                yield "\n".join(" ".join(w) for _, w in pieces[a:b]), pieces[a][0], pieces[b - 1][0]
                break


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_equal_brute_force(spark, seed):
    pick = random.Random(seed)
    sentence = lambda: " ".join(pick.choice("abcdefghij") for _ in range(pick.randint(0, 9))) + pick.choice([".", "!", "\n", "?!", " "])
    shared = ["".join(sentence() for _ in range(5)) for _ in range(4)]
    docs = [(i if i % 7 else None, "".join(pick.choice([sentence(), sentence(), pick.choice(shared)]) for _ in range(pick.randint(0, 6)))) for i in range(60)]
    docs += [(5, None), (6, ""), (8, "x"), (8, shared[0]), (8, shared[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ties = {r.text: r.tie for r in frame.select("text", F.xxhash64("text").alias("tie")).distinct().collect()}
    place = lambda d, t, i: (d is not None, d or 0, ties[t], i)
    first = {}
    for d, t in docs:
        for run, i, _ in all_runs(t, 6):
            first[run] = min(first.get(run, place(d, t, i)), place(d, t, i))
    expected = collections.Counter()
    for d, t in docs:
        gone = {k for run, i, j in all_runs(t, 6) if first[run] != place(d, t, i) for k in range(i, j + 1)}
        pieces = substrings.sentences(t)
        expected[d, None if t is None else "".join(p for k, p in enumerate(pieces) if k not in gone), len(pieces), len(gone)] += 1
    got = collections.Counter((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in substrings.without_repeats(frame, 2, 6).collect())
    assert got == expected and sum(k[3] for k in got) > 50


def every_run(text, least_words):
    pieces = [(i, s.lower().split()) for i, s in enumerate(substrings.sentences(text)) if s.split()]
    for a in range(len(pieces)):
        for b in range(a + 2, len(pieces) + 1):
            if sum(len(w) for _, w in pieces[a:b]) >= least_words:
                yield "\n".join(" ".join(w) for _, w in pieces[a:b]), pieces[a][0], pieces[b - 1][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_no_part_of_a_repeated_passage_is_left(spark, seed):
    pick = random.Random(seed)
    sentence = lambda: " ".join(pick.choice("abcdefghij") for _ in range(pick.randint(0, 9))) + pick.choice([".", "!", "\n", "?!", " "])
    shared = ["".join(sentence() for _ in range(5)) for _ in range(4)]
    docs = [(i, "".join(pick.choice([sentence(), sentence(), pick.choice(shared)]) for _ in range(pick.randint(0, 6)))) for i in range(60)]
    first = {}
    for d, t in docs:
        for run, i, _ in every_run(t, 6):
            first[run] = min(first.get(run, (d, i)), (d, i))
    expected = {d: {k for run, i, j in every_run(t, 6) if first[run] != (d, i) for k in range(i, j + 1)} for d, t in docs}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: {k for s in r.removed for k in range(s["first"], s["last"] + 1)} for r in substrings.without_repeats(frame, 2, 6, ends=True).collect()}
    assert got == expected and sum(map(len, got.values())) > 50


def test_the_query_removes_the_last_sentences_of_a_copy(spark, tmp_path):
    text = "".join(f" {' '.join(f'{c}{i}' for i in range(n))}." for c, n in zip("abcd", (20, 20, 3, 4)))
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in substrings.op8_substring_dedup(spark, str(tmp_path)).collect()} == {1: text, 2: ""}


def test_passages_at_the_edges(edge, nothing):
    got = substrings.without_repeats(edge)
    # The long text is one sentence that repeats itself: its first round stays, and the piece that holds its end.
    (long,) = {r.text for r in got.collect() if r.doc_id == 6}
    assert got.count() == len(EDGE) and long[:4800] == LONG[:4800] and long.endswith("end") and len(long) < len(LONG) / 100
    assert substrings.without_repeats(nothing).count() == 0
    assert "".join(substrings.sentences("a. b!!\n\n..c\n")) == "a. b!!\n\n..c\n"


def test_every_rule_is_tried_where_it_fits(spark):
    wild = [("^bad^", "block"), ("*tail", "block"), ("^a*z^", "allow"), ("mid", "block"), ("^bad^good^", "allow"), ("*", "allow")]
    hosts = [("org/", "allow"), ("x.org/Path/1", "block"), ("bad.net/", "allow")]
    pick = random.Random(4)
    urls = [None, "", "no scheme", "://", "http://", "s://BAD.net", "s://bad.net/x"] + [
        pick.choice(["http://", "HTTPS://", "a://b://"]) + ".".join(pick.choice(["bad", "X", "org", "net", "a", "zz", "good", "mid", "é"]) for _ in range(pick.randint(1, 4)))
        + pick.choice(["", "/", "?q=bad", "#bad", "/Path/12", "/path/1", "/bad/good/z", "/longtail", "/a\nz"]) for _ in range(300)]
    pages = spark.createDataFrame([(i // 2, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(r), v == "block", r, v) for r, v in hosts for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fits:
            return host, path, max(fits)[2], max(fits)[3]
        shapes = {r: "(?is)" + "".join({"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}.get(c) or re.escape(c) for c in r) for r, _ in wild}
        fits = [(len(r), v == "block", r, v) for r, v in wild if url is not None and re.search(shapes[r], host + path)]
        return host, path, None, max(fits)[3] if fits else "allow"

    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, hosts, wild).collect())
    assert got == collections.Counter((i // 2, *brute(u)) for i, u in enumerate(urls))
    assert url_filter.judge(pages.limit(0)).count() == 0 and {r.verdict for r in url_filter.judge(pages, [], []).collect()} == {"allow"}


def test_passages_inside_long_sentences_and_without_spaces_go(spark):
    pick = random.Random(4)
    words = lambda n: " ".join(f"w{pick.randrange(3000)}" for _ in range(n))
    shared = words(90)
    chinese = "".join(chr(0x4e00 + pick.randrange(4000)) for _ in range(20)) + "。" + "".join(chr(0x4e00 + pick.randrange(4000)) for _ in range(18)) + "！"
    long = "".join(chr(0x4e00 + pick.randrange(4000)) for _ in range(150))
    other = "".join(chr(0x4e00 + pick.randrange(4000)) for _ in range(90)) + "。"
    docs = [(1, f"{words(30)} {shared} {words(30)}."), (2, f"{words(11)} {shared.title()} {words(41)}, {words(5)}"), (3, words(300)), (4, f"{words(9)}. {shared}"),
            (5, f"{words(5)}. {chinese}"), (6, f"{other}{chinese}"), (7, f"{other[:40]}{long}"), (8, f"x {long}{other[50:]}"), (9, words(20) + ". " + words(22))]
    got = {r.doc_id: r.text for r in substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), ends=True).collect()}
    texts = dict(docs)
    assert all(got[d] == texts[d] for d in (1, 3, 5, 9))
    left = [len(set(shared.split()) & set(got[d].lower().split())) for d in (2, 4)]
    assert max(left) < 45 and chinese not in got[6] and got[6].startswith(other[:40])
    assert len(got[8]) < len(texts[8]) - 90 and got[2].split()[:5] == texts[2].split()[:5]


def test_pieces_are_the_text_and_depend_on_near_words_only():
    pick = random.Random(8)
    for _ in range(200):
        text = "".join(pick.choice(["a", "Bc", "漢", "字", " ", "  ", "\n", "\u3000", "é", "। ", ", ", "ไทย", "\ud800"]) for _ in range(pick.randint(0, 120)))
        assert "".join(substrings.sentences(text)) == text
    passage = " ".join(f"w{pick.randrange(3000)}" for _ in range(80))
    inner = [[p.strip() for p in substrings.sentences(f"{before} {passage} {after}")] for before, after in (("x " * 9, "y z"), ("q", "r " * 30))]
    assert len(set(inner[0]) & set(inner[1])) >= len(substrings.sentences(passage)) - 2 > 3
    assert substrings.n_words("ab 漢字x ไท") == 6 and substrings.n_words(" a  b ") == 2
