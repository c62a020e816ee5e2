import numpy as np
import pytest

from tidewatch.llm import vectors


def clustered(count, seed, size=16, spread=0.03):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((count // 6, size))
    which = np.where(pick.random(count) < 0.4, 0, pick.integers(0, len(centres), count))
    return centres[which] + pick.standard_normal((count, size)) * spread * np.linalg.norm(centres[which], axis=1)[:, None] / 2


def brute(rows):
    good = {}
    for vec_id, embedding, label in rows:
        ok = vec_id is not None and label is not None and embedding and all(v is not None and np.isfinite(v) for v in embedding) and any(embedding)
        if ok:
            x = np.array(embedding, np.float32).astype(np.float64)
            good[vec_id] = (label, len(x), x / np.linalg.norm(x))
    links = {i: set() for i in good}
    for a in good:
        for b in good:
            if a < b and good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    roots = {}
    for start in sorted(good):
        if start not in roots:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in roots:
                    roots[x] = start
                    todo += links[x]
    return links, roots


@pytest.mark.parametrize("block,seed", [(1024, 1), (20, 2)])
def test_counts_and_components(spark, monkeypatch, block, seed):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered(400, seed)
    rows = [(i, [float(v) for v in x[i]], int(i % 7 == 0)) for i in range(400)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)] + [rows[3], rows[5]]
    links, roots = brute(rows)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows) and all(r.n_links == len(links[r.vec_id]) for r in got)
    assert all(r.component_id == roots[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(r.n_links for r in got) > 1000


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1),
            (9, [None, 1.0], 1), (10, [float("inf"), 0.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "vec_id long, embedding array<float>, label int, node int, n int, root int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    linked = {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False)}
    assert got == {i: linked.get(i, (0, i, True)) for i, *_ in rows}
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in frame.collect()]
    by_label = {}
    for vec_id, x, label in rows:
        by_label.setdefault(label, []).append((vec_id, np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64))))
    truth = {}
    for members in by_label.values():
        x = np.array([v for _, v in members])
        truth |= dict(zip([i for i, _ in members], ((x @ x.T) >= 0.98).sum(1) - 1))
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    assert all(got[i] <= truth[i] for i in truth) and sum(got.values()) >= 0.97 * sum(truth.values())
    assert vectors.passes_for(10**9) > vectors.passes_for(10**4) >= vectors.LEAST_PASSES


@pytest.mark.parametrize("common", [0.5, 0.8, 0.9])
def test_recall_where_all_vectors_share_a_direction(spark, common):
    pick = np.random.default_rng(int(common * 10))
    size, count, pairs = 64, 6000, 300
    base = np.zeros(size)
    base[0] = np.sqrt(common)

    def away(n):
        x = pick.standard_normal((n, size - 1))
        return x / np.linalg.norm(x, axis=1)[:, None]

    rest = away(count)
    x = np.hstack([np.full((count, 1), base[0]), rest * np.sqrt(1 - common)])
    # The partner stands at a cosine of 0.982 from the first of its pair.
    turn = (0.982 - common) / (1 - common)
    side = away(pairs)
    side -= (side * rest[:pairs]).sum(1)[:, None] * rest[:pairs]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x[count - pairs:, 1:] = np.sqrt(1 - common) * (turn * rest[:pairs] + np.sqrt(1 - turn**2) * side)
    rows = [(i, [float(v) for v in r], "one label") for i, r in enumerate(x)]
    got = {r.vec_id: r.component_id for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    found = sum(got[count - pairs + i] == got[i] for i in range(pairs))
    assert found >= 0.95 * pairs


def test_very_large_and_very_small_numbers(spark):
    rows = [(1, [1e200, 1e199], 1), (2, [2e200, 2e199], 1), (3, [1e-200, 1e-201], 1), (4, [-1e200, 1e200], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
