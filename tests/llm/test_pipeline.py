import os

import pytest

import corpus_pipeline
from sparkwell.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_chain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, DATA), name)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name != "packing":
            assert docs.columns == columns
    assert {"sequence_id", "offset", "ids_crc32"} <= set(docs.columns)


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) == 10
