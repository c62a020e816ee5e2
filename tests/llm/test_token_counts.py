import random

import public_tokenizers
import pytest
import sentencepiece

from tidewatch.llm import token_counts
from tidewatch.llm.token_counts import op13_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_every_count_is_the_encoders_on_the_whole_text(spark, folder):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op13_token_counts(spark, folder).collect()}
    assert len(found) == len(texts)
    for row in texts:
        text, result = row.text or "", found[row.doc_id]
        assert result.n_tokens == len(MODEL.encode(text))
        assert result.n_bytes == len(text.encode())
        assert result.over_limit == (result.n_tokens > 4096)


def test_pretokens_add_up_to_the_text():
    draw = random.Random(5)
    parts = [" ", "  ", "▁", "a", "\n", "é", "中", "😀", "\x00", "the", "ing", "<s>", "<unk>", "​", "\xa0", "<0x0A>", "\t"]
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        for size in (1, 4, 1000):
            assert sum(token_counts.pretoken_length(MODEL, p) for block in token_counts.pretokens(text, size) for p in block) == len(MODEL.encode(text)), text


def test_edges(spark, edge, nothing):
    found = token_counts.token_counts(edge, ["doc_id", "score", "key"], PATH).collect()
    assert len(found) == edge.count()
    texts = {(r.doc_id, r.text) for r in edge.collect()}
    assert sorted((str(r.doc_id), r.n_tokens) for r in found if r.n_bytes) == sorted(
        (str(r.doc_id), len(MODEL.encode(r.text))) for r in edge.collect() if r.text)
    assert all(r.n_tokens == 0 and not r.over_limit for r in found if not r.n_bytes)
    assert max(r.n_tokens for r in found) == max(len(MODEL.encode(t or "")) for _, t in texts)
    assert token_counts.token_counts(nothing, ["doc_id"], PATH).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(edge.withColumn("n_tokens", edge.score), ["n_tokens"], PATH)


def test_a_full_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 3)
    lengths = token_counts.Lengths(MODEL, {"▁the": 1})
    words = ["▁" + w for w in "the one two three four five the one".split()]
    assert [lengths[w] for w in words] == [token_counts.pretoken_length(MODEL, w) for w in words]
    assert len(lengths) <= 3 and "▁the" not in lengths


def test_a_model_that_cannot_be_split_encodes_whole_texts(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "_loaded", lambda content: (sentencepiece.SentencePieceProcessor(model_proto=content), False))
    found = token_counts.token_counts(edge.where("length(text) < 100"), ["doc_id"], PATH).collect()
    assert sum(r.n_tokens for r in found) == sum(len(MODEL.encode(r.text)) for r in edge.where("length(text) < 100").collect())
