"""The pipeline's stages: columns, effect and what each leaves alone."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = docs.columns, docs
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, after, SF).collect(), docs.schema)
        now = {r["doc_id"] for r in after.collect()}
        assert after.columns == before and now <= ids and len(now) > 0.5 * len(ids), name
        ids = now
    texts = {r["text"] for r in after.collect()}
    assert len(texts) == after.count()
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in t for b in benchmark for t in texts)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, after, SF).collect()
    assert {r["doc_id"] for r in pieces} == ids


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["length"] > 0 for r in rows)
