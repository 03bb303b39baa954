"""The pipeline on small made tables, stage by stage and as a whole."""

import os
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from sweepfield.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
        kept = docs
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts))
    done = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert done.count() == before and done.filter("NOT lossless").isEmpty()


def test_empty_documents_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_eleven_queries_are_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.encode])
def test_python_gets_few_texts_at_once(spark, stage):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    try:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        stage(spark, docs.limit(5), DATA)  # its result is read by the caller, under what the stage has set
        sizes = spark.range(0, 2_500, 1, 1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
        assert sizes.agg({"n": "max"}).first()[0] <= corpus_pipeline.TEXT_ROWS
    finally:
        spark.conf.set(name, before)
