import importlib

import pytest
from oracle import compare

import corpus_pipeline
from tidewatch.llm import catalog
from tidewatch.session import cut_lineage

from .conftest import EDGE


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    ok, message = compare(spark, duck, folder, name, catalog.QUERIES[name], catalog.SQL[name])
    assert ok, message


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    entry = importlib.import_module("__spark_entry__")
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], folder)))
    return out


def test_stages_hand_on_documents(spark, folder, stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] > 0
    toxic = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").select("doc_id")
    assert stages[1].join(toxic, "doc_id").count() <= 0.3 * toxic.count()


def test_stages_keep_whole_rows(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.exceptAll(before).count() == 0
    assert stages[4].distinct().join(stages[3], [*stages[3].columns], "left_anti").count() == 0


def test_exact_copies_go(stages):
    assert stages[2].select("text").distinct().count() == stages[2].count()


def test_every_word_left_is_in_the_shards(stages):
    left = {r.doc_id for r in stages[4].select("doc_id").distinct().collect()}
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == left


def test_run_applies_the_stages(spark, folder, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, stages[5].collect()))


def test_stages_at_the_edges(spark, folder, edge, nothing):
    for docs, least in ((edge, 1), (nothing, 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, folder))
            assert docs.count() >= least
    assert len(EDGE) > 10
