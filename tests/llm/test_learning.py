"""Quality and toxicity: held-out accuracy on the given tables, and edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import quality, toxicity

from .conftest import EDGE, LONG

SMALL = "/root/testdata/sf0.1"


def test_indicators_do_not_depend_on_earlier_texts_or_blocks(monkeypatch):
    texts = ["one two two two THREE!! four", "", " \n", "éü | ñ", LONG[:5000], "x"]
    fresh = [quality.Indicators()(t).tolist() for t in texts]
    again = quality.Indicators()
    assert [again(t).tolist() for t in [*texts, *texts]] == fresh + fresh and fresh[1] == fresh[2] == []
    assert quality.Indicators()("a b") .tolist() == quality.Indicators()(" a\t\n b ").tolist()
    assert set(quality.Indicators()("same same same").tolist()) != set(quality.Indicators()("same some sane").tolist())


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, ["doc_id"], quality.train(docs, labels)).withColumn("held_out", quality.held_out())
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = np.array([(r.score >= 0.3) == (r.quality == 1) for r in rows])
    bad = np.array([r.quality == 0 for r in rows])
    assert len(rows) > 500 and right.mean() > 0.98 and right[bad].mean() > 0.9
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in scored.limit(500).collect())


def test_quality_at_the_edges(spark, edge, labels, nothing):
    scored = quality.score(edge, ["doc_id"], quality.train(edge, labels))
    got = scored.collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert {r.score for r in quality.score(edge, ["doc_id"], quality.train(edge, labels.limit(0))).collect()} == {0.5}
    assert quality.score(nothing, ["doc_id"], quality.train(nothing, labels)).count() == 0


def test_the_sample_is_bounded(spark, edge, labels):
    assert quality.labelled(edge, labels, "quality", 1).select("doc_id").distinct().count() == 1


def test_chain_on_unlabelled_and_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.xxhash64("doc_id") % 4 != 0)
    scored = toxicity.score(docs, ["doc_id"], toxicity.train(docs, known))
    rows = scored.join(labels.join(known.select("doc_id"), "doc_id", "left_anti"), "doc_id").collect()
    toxic, said = np.array([r.toxic == 1 for r in rows]), np.array([r.rejected for r in rows])
    assert toxic.sum() > 50 and said[toxic].mean() > 0.8 and said[~toxic].mean() < 0.01


def test_later_models_use_earlier_chances():
    pick = np.random.default_rng(0)
    x = (pick.random((600, 5)) < 0.5).astype(np.float32)
    targets = np.column_stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0)]).astype(int)
    weights, threshold = toxicity.fit_chain(toxicity.Sparse([np.flatnonzero(row) for row in x], 5), targets)
    assert [len(w) for w in weights] == [6, 7] and weights[1][5] > 0
    rows = toxicity.Sparse([np.flatnonzero(row) for row in x], 5)
    last = rows.with_column(rows.chances(weights[0])).chances(weights[1])
    assert ((last >= threshold) == targets[:, 1]).mean() > 0.99


def test_toxicity_at_the_edges(spark, edge, labels, nothing):
    for known in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.score(edge, ["doc_id", "text", "rejected"], toxicity.train(edge, known), prefix="__").collect()
        assert len(got) == len(EDGE) and not any(r["__rejected"] for r in got if r.text is None)
    assert toxicity.score(nothing, ["doc_id"], toxicity.train(nothing, labels)).count() == 0
    assert toxicity.terms(None) == set() and "lowe*" in toxicity.terms("LOWEbert") and len(toxicity.terms(LONG)) > 977
