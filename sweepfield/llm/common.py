"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepfield.functions.arrays import bound, fold_collect
from sweepfield.session import shared_folder

# Rows of a few dozen bytes: a table below this count may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_case(text: Column) -> Column:
    """Lower-case for comparing with ASCII words.

    ``lower`` is much cheaper than a character map. It also changes letters
    outside ASCII, but only the Kelvin sign would become an ASCII letter, so
    that one is swapped for another sign first. Word borders stay the same.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def word_arrays(docs: DataFrame, text: Column, separator: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns and ``_w``, the pieces between separators without empty ones at the ends."""
    cut = docs.select(*keep, F.split(text, separator, -1).alias("_s"))
    lead = (F.get("_s", F.lit(0)) == "").cast("int")
    trail = (F.element_at("_s", -1) == "").cast("int")
    names = cut.columns[:-1]
    return cut.select(*names, F.slice("_s", lead + 1, F.greatest(F.size("_s") - lead - trail, F.lit(0))).alias("_w"))


def gram_arrays(rows: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``_h``, the hash of the k words from each position of ``_w``.

    Hashes of two overlapping halves are combined, so each position costs a
    few hash calls whatever k is. Texts with fewer words give an empty array.
    Explode the result with ``posexplode_outer``: for the inner form Catalyst
    adds a filter on the array's size and computes every array twice per level.
    """
    rows = rows.select(*keep, F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    span = 1
    while span < k:
        step = min(span, k - span)
        later = F.slice("_h", step + 1, 2_000_000_000)
        rows = rows.select(*keep, "_n", F.zip_with("_h", later, lambda a, b: F.xxhash64(a, b)).alias("_h"))
        span += step
    return rows.select(*keep, F.slice("_h", 1, F.greatest(F.col("_n") - k + 1, F.lit(0))).alias("_h"))


def broadcast_if_counted(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table when a bounded count proves it small; otherwise leave the join to shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def known_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, _y)`` of ``labels(doc_id, label)``, one row per document, labels 0 and 1 only."""
    return labels.select("doc_id", F.col("label").cast("int").alias("_y")).filter("_y IN (0, 1) AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def labelled(docs: DataFrame, known: DataFrame, score) -> DataFrame:
    """``known`` joined with what ``score(docs)`` gives for each document; ``score`` keeps ``doc_id``.

    Few labels are broadcast and pick the documents to score. With more of
    them all documents are scored, and only the narrow result is shuffled.
    """
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return score(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(known), "doc_id")
    return score(docs).join(known, "doc_id")


def same(pairs: list[tuple[Column, Column]]) -> Column:
    """Equality of all pairs, nulls equal to each other."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written below the shared checkpoint folder and read back: lineage cut, size known."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def automatic_joins(spark: SparkSession, limit: str):
    """What runs inside broadcasts a table by itself only up to this size of its files, or of its rows where they were measured.

    A file of equal or sorted numbers packs to a twentieth of its rows, and the driver holds the rows.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, limit)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What runs inside hands at most so many rows at a time to Python; for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder and read back, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def match_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, end, hit, gap, rest>>``.

    Positions are code points, ``end`` exclusive; ``gap`` is the text between
    the previous match and this one, ``rest`` the text up to the next match.
    The matches and the gaps come from one extraction and one split, and the
    positions from a fold in blocks, so a text may hold any number of matches.
    """
    span = "array<struct<start:long,end:long,hit:string,gap:string,rest:string>>"

    def pairs(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        later = F.slice(gaps, 2, 2_000_000_000)
        return F.zip_with(hits, F.arrays_zip(gaps.alias("gap"), later.alias("rest")), lambda h, g: F.struct(
            h.alias("hit"), g["gap"].alias("gap"), g["rest"].alias("rest")))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        first = at + F.char_length(pair["gap"])
        end = first + F.char_length(pair["hit"])
        return end, F.array(F.struct(
            first.alias("start"), end.alias("end"), pair["hit"].alias("hit"), pair["gap"].alias("gap"), pair["rest"].alias("rest")))

    matched = F.filter(bound(F.split(text, pattern, -1), pairs), lambda p: p["hit"].isNotNull())
    return fold_collect(matched, F.lit(0).cast("long"), step, span)


def span_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` comma-joined; ``spans`` holds structs sorted by start and kind rank."""
    names = F.array(*[F.lit(k) for k in kinds])
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def count_kind(spans: str, kind: int) -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def slices(batch, text_column: int, limit: int = 8_000_000):
    """Consecutive parts of an Arrow batch with about ``limit`` bytes of text each; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
