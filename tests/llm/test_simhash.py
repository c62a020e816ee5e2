import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidewatch.llm import common, simhash

from .conftest import EDGE, rows


def brute(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    value = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_fingerprint_equals_its_definition_whole_and_in_blocks(size, monkeypatch):
    pick = random.Random(size)
    texts = [None] + [" \t\n"[n % 3].join(pick.choice(["Aé", "b", "İx", "ſ", "c d", "E\x1cF"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 50, 300)]
    whole = [simhash.simhash(t, size) for t in texts]
    assert whole == [brute(t, size) for t in texts]
    monkeypatch.setattr(common.word_blocks, "__defaults__", (7,))
    assert [simhash.simhash(t, size) for t in texts] == whole


@pytest.mark.parametrize("radius,parts", [(3, 2), (3, 3), (7, 4), (2, 2)])
def test_segments_reach_every_pair_within_the_radius(radius, parts):
    cuts = simhash.segments(radius, parts)
    assert sum(b for _, _, b in cuts) == radius - parts + 1 and sum(w for _, w, _ in cuts) == 64
    pick = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in pick.sample(range(64), radius))
        assert any(bin(flips >> s & (1 << w) - 1).count("1") <= b for s, w, b in cuts)


def near_fingerprints(count, seed):
    pick = np.random.default_rng(seed)
    centres = pick.integers(-(1 << 63), 1 << 63, 40, np.int64)
    out = []
    for _ in range(count):
        value = int(centres[pick.integers(0, 6 if pick.random() < 0.7 else 40)]) & (1 << 64) - 1
        for b in pick.choice(64, pick.integers(0, 6), replace=False):
            value ^= 1 << int(b)
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


@pytest.mark.parametrize("radius,parts,crowded", [(3, 2, 128), (3, 2, 3), (7, 4, 4)])
def test_components_equal_all_pairs(spark, monkeypatch, radius, parts, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "CROWDED_TIMES_MEAN", 0)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    fps = near_fingerprints(400, radius + crowded) + [0, 0, -1]
    got = {r.doc_id: r.component_id for r in simhash.groups(
        spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long"), radius, parts).collect()}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(fps, np.int64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count((values[i] ^ values).view(np.uint64)) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(fps))}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 300)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7} | {i: 7 for i in range(200, 300)}


def test_edges(spark, edge, nothing):
    prints = simhash.fingerprints(edge, ["doc_id"])
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.groups(prints).collect()), key=str)
    assert len(got) == len(EDGE) and all(fp == 0 for d, fp, _ in got if d in (3, 4, 5))
    assert {c for d, _, c in got if d in (1, 2)} == {1} and {c for _, fp, c in got if fp == 0} == {3}
    assert [c for d, fp, c in got if d is None and fp] == [None]
    assert simhash.groups(simhash.fingerprints(nothing, ["doc_id"])).count() == 0


def test_one_row_of_each_group_stays(spark, edge, nothing):
    kept = simhash.one_per_group(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([(False, 1), (False, 3), (True, 0), (False, 6), (False, 7), (False, 7), (False, 8), (False, -9223372036854775808)])
    assert simhash.one_per_group(nothing).count() == 0
    assert simhash.one_per_group(spark.createDataFrame(rows([(None, "a b", None), (None, "a b", None)]), edge.schema)).count() == 1


def test_the_pipeline_keeps_the_first_of_each_group(spark):
    pick, texts = random.Random(3), [None, "", "a b", "A  b", "a c"]
    for _ in range(25):
        base = [f"w{pick.randrange(5000)}" for _ in range(pick.choice([40, 200, 900]))]
        texts.append(" ".join(base))
        for changed in (0, 1, 1, 2, 3, 20):
            copy = list(base)
            for at in pick.sample(range(len(base)), changed):
                copy[at] = f"v{pick.randrange(5000)}"
            texts.append(" ".join(copy).title())
    prints, parent = [brute(t, 3) & (1 << 64) - 1 for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    apart = linked = 0
    for i in range(len(texts)):
        for j in range(i):
            bits = (prints[i] ^ prints[j]).bit_count()
            if bits <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            linked += 0 < bits <= 3
            apart += 3 < bits < 16
    frame = spark.createDataFrame(rows([(i, t, "a") for i, t in enumerate(texts)]), "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, size long, key long, tie long, first_id long, copies int, rejected boolean, y int")
    kept = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]
    assert linked > 10 and apart > 10
