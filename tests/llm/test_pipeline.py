"""The pipeline's stages against brute force and on empty and awkward tables."""

import pytest
from test_llm_operators import SCHEMA, awkward, brute_components, brute_quality

import corpus_pipeline as pipe
from leafwright.llm import bpe, secrets


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).select(pipe.COLUMNS).cache()


def test_stages_keep_the_columns(spark, docs):
    d = docs
    for name, stage in pipe.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == pipe.COLUMNS, name
        assert stage(spark, docs.limit(0), "").count() == 0


def test_quality_keeps_what_the_operator_keeps(spark, docs):
    rows = docs.collect()
    want = [r for r, v in zip(rows, brute_quality([(r.text, r.lang) for r in rows]), strict=True) if v[2]]
    assert sorted(map(str, pipe.quality(spark, docs, "").collect())) == sorted(map(str, want))


def test_neardup_keeps_one_row_of_each_group(spark, docs):
    rows = [tuple(r) for r in docs.collect() if r.doc_id is not None]
    worded = lambda t: bool((t or "").split())
    want = sorted({k[0] for k, r in zip(brute_components(rows), rows, strict=True) if k[3] and worded(r[1])})
    got = sorted(r.doc_id for r in pipe.neardup(spark, docs.where("doc_id is not null"), "").collect() if worded(r.text))
    assert got == want


def test_secrets_go_and_documents_stay(spark, docs):
    got = pipe.secrets(spark, docs, "").collect()
    want = [(r.doc_id, secrets.redact(r.text, secrets.find(r.text)) if r.text else r.text) for r in docs.collect()]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, want))
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id == 21)


def test_mixing_repeats_at_most_twice(spark, docs):
    n = pipe.mixing(spark, docs.where("doc_id > 7"), "").groupBy("doc_id").count().collect()
    assert all(r["count"] <= 2 for r in n)


def test_run(spark):
    out = pipe.run(spark, "/root/testdata/sf0.001")
    codec = bpe.TreeCodec(*bpe.vocabulary())
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    kept = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(codec.decode(r.ids).decode() == secrets.redact(kept[r.doc_id], secrets.find(kept[r.doc_id])) for r in rows)
