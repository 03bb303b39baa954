"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepfield.session import apply_settings
from sweepfield.llm.common import table
from sweepfield.llm.sql import ORACLES

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
WORD_FILE = "/opt/tokenizers/word_bpe_49k.json"


def op1_exact_dedup(spark, sf_dir):
    from sweepfield.llm import exact_dedup

    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark, sf_dir, model_file=MODEL_FILE):
    from sweepfield.llm import sentencepiece_codec

    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.Vocabulary.load(model_file))


def op3_secrets(spark, sf_dir):
    from sweepfield.llm import secrets

    docs = table(spark, sf_dir, "documents")
    ratios = secrets.train_markov(secrets.labelled_samples(docs))
    return secrets.digest(secrets.find_secrets(docs, ratios))


def op4_licenses(spark, sf_dir):
    from sweepfield.llm import licenses

    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op5_decontamination(spark, sf_dir):
    from sweepfield.llm import decontaminate

    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_fp")


def op6_chat_formatting(spark, sf_dir):
    from sweepfield.llm import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    parts = turns.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts("text").alias("parts"))
    return chat.digest(chat.format_chats(parts))


def op7_pii(spark, sf_dir):
    from sweepfield.llm import pii

    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark, sf_dir):
    from sweepfield.llm import jaccard_join

    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("links")


def _part(parts):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def _held(parts, held):
    return F.coalesce(_part(parts) == held, F.lit(False)).alias("held_out")


def learnable(labels, column, parts, held):
    """Labels of the documents that are not held out."""
    return labels.filter(_part(parts) != held).select("doc_id", F.col(column).alias("label"))


def op9_quality(spark, sf_dir):
    from sweepfield.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_labelled(docs, learnable(table(spark, sf_dir, "labels"), "quality", 4, 2))
    return quality.score_quality(docs, model).select(
        "doc_id", _held(4, 2), "score", (F.col("score") >= quality.PASS_SCORE).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir):
    from sweepfield.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_labelled(docs, learnable(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    return toxicity.score_toxicity(docs, model, keep=["doc_id"]).select(
        "doc_id", _held(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_bpe(spark, sf_dir, vocabulary_file=WORD_FILE):
    from sweepfield.llm import bpe_trie

    vocabulary = bpe_trie.BpeVocabulary.load(vocabulary_file)
    return bpe_trie.digest(bpe_trie.decode(bpe_trie.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary))


def op12_hard_negatives(spark, sf_dir):
    from sweepfield.llm import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


def op13_structure_repair(spark, sf_dir):
    from sweepfield.llm import structure_repair

    turns = table(spark, sf_dir, "conversations")
    return structure_repair.summary(turns, structure_repair.damage(turns))


QUERIES = [
    op1_exact_dedup, op2_sentencepiece, op3_secrets, op4_licenses, op5_decontamination, op6_chat_formatting, op7_pii, op8_jaccard_join,
    op9_quality, op10_toxicity, op11_bpe, op12_hard_negatives,
    op13_structure_repair,
]


def _run(function):
    def run(spark, sf_dir):
        return function(spark=apply_settings(spark), sf_dir=sf_dir)

    return run


def queries():
    return {f.__name__: _run(f) for f in QUERIES}


def oracle_sql():
    return dict(ORACLES)
