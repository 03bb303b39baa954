"""The corpus pipeline: five stages from raw documents to token ids.

Each stage reads all that its predecessor kept. The first four drop rows and
return the columns of documents; the last returns the ids of what is left.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from sweepfield.llm import decontaminate, exact_dedup, jaccard_join, sentencepiece_codec, toxicity
from sweepfield.llm.catalog import MODEL_FILE, learnable
from sweepfield.llm.common import table, written
from sweepfield.session import apply_settings

TOXIC = 0.5
TEXT_ROWS = 1_000


def text_rows(stage):
    """The stage with at most ``TEXT_ROWS`` rows at a time for Python, also when its result is read.

    Rows hold whole texts, and a worker that once held ten thousand keeps that memory through the stages after.
    """

    @wraps(stage)
    def run(spark, docs, sf_dir):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@text_rows
def drop_toxic(spark, docs, sf_dir):
    """Documents that score below ``TOXIC``. Labels of held-out documents are not learned from."""
    model = toxicity.fit_labelled(docs, learnable(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    scored = toxicity.score_toxicity(docs, model, score_col="_toxic")
    return scored.filter(F.col("_toxic") < TOXIC).select(*docs.columns)


def drop_exact_copies(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@text_rows
def drop_near_copies(spark, docs, sf_dir):
    """One document of each component of similar texts."""
    return jaccard_join.drop_near_copies(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents without any verified overlap with a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@text_rows
def encode(spark, docs, sf_dir):
    """Token ids of every document."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.Vocabulary.load(MODEL_FILE))


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks), ("sentencepiece", encode),
]
# Trained scores and keyed draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the documents table, each one's output written and read again."""
    apply_settings(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
