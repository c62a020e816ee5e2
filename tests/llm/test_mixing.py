import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing

from .conftest import EDGE


def brute(rows, seed=mixing.SEED, weights=(1, 2, 3), passes=3):
    """(doc_id, size, source_size, target, taken) by one queue in memory."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    held, total = collections.Counter(), sum(sizes)
    for (_, _, s), n in zip(rows, sizes):
        held[s] += n
    full = set()
    while True:
        rest, shares = total - sum(passes * held[s] for s in full), sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and passes * held[s] * shares <= rest * weight[s]}
        if not over:
            break
        full |= over
    target = {s: float(passes * held[s]) if s in full else rest * weight[s] / shares for s in sources}
    queue, sums = [], collections.Counter()
    turn = [hashlib.md5(f"{'' if d is None else d}:{seed}".encode()).hexdigest() for d, _, _ in rows]
    for i in sorted(range(len(rows)), key=lambda i: (turn[i], sizes[i])):
        d, _, s = rows[i]
        sums[s] += sizes[i]
        queue += [((p * held[s] + sums[s]) / weight[s], s is None, s or "", turn[i], i) for p in range(passes)]
    taken, used = collections.Counter(), 0
    for *_, i in sorted(queue):
        if used + sizes[i] > total:
            break
        used += sizes[i]
        taken[i] += sizes[i]
    return [(d, sizes[i], held[s], target[s], taken[i]) for i, (d, _, s) in enumerate(rows)]


@pytest.mark.parametrize("seed,slices", [(1, 100_000), (2, 7), (3, 1)])
def test_mix_equals_one_queue(spark, monkeypatch, seed, slices):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slices)
    pick = random.Random(seed)
    names = [None, "", "hot", "é", "z", "a", "B", "\U0001F600", "￿"]
    rows = [(i, " ".join("w" for _ in range(pick.choice([0, 1, 3, 20, 100]))), pick.choice([*names, "hot", "hot", "hot"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(mixing.sized(frame)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r["size"] * r.copies) for r in got) == brute(rows)
    words, goal = collections.Counter(), {}
    for r in got:
        words[r.source] += r["size"] * r.copies
        goal[r.source] = r.target
    assert all(abs(words[s] - goal[s]) <= 200 for s in goal) and sum(words.values()) <= sum(r["size"] for r in got)


def test_edges(spark, edge, nothing):
    got = mixing.mix(mixing.sized(edge))
    assert got.count() == len(EDGE) and got.where("copies > 3 OR copies < 0").count() == 0
    assert {r.copies for r in got.where("size = 0").collect()} == {0}
    whole = mixing.mixed(edge)
    assert whole.columns == edge.columns
    assert sum(r.copies for r in got.collect()) == whole.count()
    assert mixing.mix(mixing.sized(nothing)).count() == 0 and mixing.mixed(nothing).count() == 0
    empty = mixing.mix(mixing.sized(edge.where("doc_id IN (3, 4, 5)"))).collect()
    assert [(r.copies, r.target) for r in empty] == [(0, 0.0)] * 3
    assert mixing.mixed(edge.where("doc_id IN (3, 4, 5)")).count() == 0


def test_equal_rows_share_a_fate(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d", "t")] * 50, "doc_id long, text string, source string")
    got = mixing.mix(mixing.sized(rows)).groupBy("doc_id").agg(F.countDistinct("copies").alias("n")).collect()
    assert {r.n for r in got} == {1}
