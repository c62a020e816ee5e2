import glob
import os

import numpy as np
import pytest

from tidewatch.llm import tokens
from tidewatch.session import scratch_path, shared_folder

from .conftest import EDGE


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_the_permutation_and_its_inverse(size):
    moved = tokens.permuted(np.arange(size), size)
    assert sorted(moved) == list(range(size)) and (tokens.permuted(moved, size, back=True) == np.arange(size)).all()
    assert size < 50 or (moved != tokens.permuted(np.arange(size), size, key=1)).any()


def test_a_very_large_permutation():
    size = (1 << 61) + 12345
    places = np.random.default_rng(0).integers(0, size, 1000)
    moved = tokens.permuted(places, size)
    assert 0 <= moved.min() and moved.max() < size and (tokens.permuted(moved, size, back=True) == places).all()


def encoding():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens._encoding(f.read())


@pytest.mark.parametrize("size", [1, 191, 192, 193, 300, 16_320, 16_321, 50_257, 65_536])
def test_ids_come_back_from_their_bytes(size):
    draw = np.random.default_rng(size)
    order, ids = draw.permutation(size).astype("<u2"), np.concatenate([np.arange(size), draw.integers(0, size, 1000)]).astype("<u2")
    leads, tails, more = tokens._bytes_of(order)(ids)
    assert len(leads) == len(ids) and more.sum() == len(tails) and (tokens._ids_of(order, leads, tails) == ids).all()
    assert (tokens._bytes_of(order)(order)[2] == [(place >= 192) + (place >= 16_320) for place in range(size)]).all()


def test_ids_are_stored_and_travel_in_less_than_a_byte(spark, folder, monkeypatch):
    docs, packs, real = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), [], tokens._packs
    monkeypatch.setattr(tokens, "_packs", lambda *a: packs.append(real(*a)) or packs[-1])
    monkeypatch.setattr(tokens, "scratch_path", lambda spark, name: scratch_path(spark, f"test-{name}"))
    before = set(glob.glob(f"{shared_folder(spark)}/tidewatch/test-token-ids-*"))
    path = scratch_path(spark, "test-shards")
    n_ids = tokens.read_shards(spark, path, tokens.write_shards(docs, path)).agg({"count": "sum"}).first()[0]
    (stored,) = set(glob.glob(f"{shared_folder(spark)}/tidewatch/test-token-ids-*")) - before
    moved = sum(len(x) for r in packs[0].collect() for x in r if isinstance(x, (bytes, bytearray)))
    assert sum(os.path.getsize(f) for f in glob.glob(f"{stored}/*.parquet")) < n_ids and moved < n_ids


def test_long_texts_are_cut_where_ids_do_not_change():
    text = " ".join(["a\n b  c", "döner", "  ", "x\ty", " q"] * 50)
    assert list(tokens.encoded(encoding(), text, 7)) == encoding().encode_ordinary(text)


def test_round_trip_with_edges(spark, edge):
    path = scratch_path(spark, "test-shards")
    per_shard = tokens.write_shards(edge.select("doc_id", "text"), path, shard_bytes=300_000)
    rows = tokens.read_shards(spark, path, per_shard).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len({r.shard for r in rows}) > 3
    assert all(r.shard == r.slot // per_shard for r in rows)
    known = tokens.shards(spark, path).orderBy("shard").collect()
    assert sum(s.sequences for s in known) == len(rows)
    last = np.memmap(known[-1].path.removeprefix("file:"), tokens.record_type(tokens.LENGTH), "r")
    assert len(last) == known[-1].sequences and not last["end"].any()
    assert {s.sequences for s in known[:-1]} == {per_shard} and (last["slot"] == known[-1].shard * per_shard + np.arange(len(last))).all()
    closing = max(encoding()._mergeable_ranks.values()) + 1
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append((r.chunk, np.frombuffer(r.ids, "<u2")[: r["count"]].tolist()))
    for doc, text in {d: t for d, t, _ in EDGE if d not in (1, 7, None)}.items():
        ids = [i for _, part in sorted(texts[doc]) for i in part]
        assert ids[-1] == closing and encoding().decode(ids[:-1]) == (text or "")
    assert len(texts[1]) == 2 and len(texts[7]) == 2 and len(texts[None]) == 2


def test_the_order_depends_on_data_and_key_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    order = lambda d, **k: [(r.doc_id, r.chunk) for r in _written(spark, d, **k).orderBy("slot").collect()]
    first = order(docs)
    assert first == order(docs.repartition(5)) and first != order(docs, key=5) and first != sorted(first)


def _written(spark, docs, length=tokens.LENGTH, **more):
    path = scratch_path(spark, "test-shards")
    return tokens.read_shards(spark, path, tokens.write_shards(docs, path, length, **more), length)


def test_repeated_rows_are_spread_as_copies(spark):
    docs = spark.createDataFrame([(i // 3, f"text {i // 3}") for i in range(300)], "doc_id long, text string").coalesce(1)
    got = [r.doc_id for r in _written(spark, docs).orderBy("slot").collect()]
    assert sorted(got) == [i // 3 for i in range(300)] and sum(a == b for a, b in zip(got, got[1:])) < 20


def test_every_slot_is_the_permuted_number_for_any_layout(spark):
    texts = {d: " ".join(f"w{d} {i}" for i in range(40 * (d % 5))) for d in range(40)}
    rows = [(d, texts[d]) for d in range(40) for _ in range(3)] + [(None, "no id"), (None, None), (None, "no id"), (7, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {(r.doc_id, r.text): r.tie for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS tie").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie[r]))
    expected, number = [], 0
    counts = [-(-(len(encoding().encode_ordinary(t or "")) + 1) // 8) for _, t in ordered]
    for (doc, _), n in zip(ordered, counts):
        slots = tokens.permuted(np.arange(number, number + n), sum(counts)).tolist()
        expected += [(s, doc, c) for c, s in enumerate(slots)]
        number += n
    for layout in (docs.coalesce(1), docs.repartition(3), docs.repartition(11, "doc_id")):
        got = _written(spark, layout, length=8, shard_bytes=2_000)
        assert sorted((r.slot, r.doc_id, r.chunk) for r in got.collect()) == sorted(expected)


def test_nothing(spark, nothing):
    assert tokens.materialise(nothing.select("doc_id", "text"), "test-shards").count() == 0
