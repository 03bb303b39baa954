"""Exact duplicates: counting quotient filters first, bytes only where a fingerprint repeats.

Every partition builds one counting quotient filter over the fingerprints of
its texts, cut into shards by the leading fingerprint bits. A filter keeps a
fingerprint as a quotient (its place) and a remainder (what is stored), so it
gives back exactly what went in and two filters merge losslessly by walking
their sorted remainders. A hot text is one slot and a counter in each
partition, so the shuffle carries at most one entry per text and partition.
Only texts whose merged count is above one are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.llm.common import broadcast_if_counted, text_of, written

# Runs of white space that are not already one space.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
SHARD_BITS = 8


def normalised(text: Column) -> Column:
    """White space runs as one space; nothing is trimmed."""
    return F.regexp_replace(text, SPACES, " ")


class QuotientFilter:
    """Counting quotient filter over sorted values of ``width`` bits.

    ``occupied`` marks the quotients in use, ``run_end`` the last slot of each
    quotient's run, ``counter`` the slots that hold the count of the slot
    before. Slots stand in order of quotient, then remainder.
    """

    def __init__(self, width: int, quotient_bits: int, occupied, run_end, counter, slots) -> None:
        self.width, self.quotient_bits = width, quotient_bits
        self.occupied, self.run_end, self.counter, self.slots = occupied, run_end, counter, slots

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """``values``: sorted distinct uint64 below ``2 ** width``; ``counts``: how often each came."""
        bits = min(max(int(len(values) - 1).bit_length(), 0), width // 2)
        shift = np.uint64(width - bits)
        quotients = (values >> shift).astype(np.int64)
        sizes = 1 + (counts > 1)
        first = np.cumsum(sizes) - sizes
        slots = np.zeros(int(sizes.sum()), np.uint64)
        slots[first] = values & np.uint64((1 << (width - bits)) - 1)
        counter = np.zeros(len(slots), bool)
        many = counts > 1
        slots[first[many] + 1] = counts[many].astype(np.uint64)
        counter[first[many] + 1] = True
        occupied = np.zeros(1 << bits, bool)
        occupied[quotients] = True
        run_end = np.zeros(len(slots), bool)
        last = np.flatnonzero(np.append(quotients[1:] != quotients[:-1], True)) if len(values) else np.array([], np.int64)
        run_end[(first + sizes - 1)[last]] = True
        return cls(width, bits, occupied, run_end, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The values in order and their counts."""
        run = np.cumsum(self.run_end) - self.run_end
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        held = ~self.counter
        values = (quotients[run[held]] << np.uint64(self.width - self.quotient_bits)) | self.slots[held]
        counts = np.ones(int(held.sum()), np.int64)
        counts[np.flatnonzero(np.append(self.counter[1:], False)[held])] = self.slots[self.counter].astype(np.int64)
        return values, counts

    @classmethod
    def merge(cls, filters: list[QuotientFilter], width: int) -> QuotientFilter:
        """All filters as one: values met in sorted order, counts added."""
        if not filters:
            return cls.build(np.array([], np.uint64), np.array([], np.int64), width)
        values, counts = (np.concatenate(x) for x in zip(*[f.items() for f in filters]))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.array([], np.int64)
        return cls.build(values[starts], np.add.reduceat(counts, starts) if len(starts) else counts, width)

    def to_bytes(self) -> bytes:
        head = np.array([self.width, self.quotient_bits, len(self.slots)], np.int64).tobytes()
        size = max(-(-(self.width - self.quotient_bits) // 8), 4)
        body = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.run_end).tobytes() + np.packbits(self.counter).tobytes() + body

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        width, bits, n = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at = 24

        def flags(count):
            nonlocal at
            size = -(-count // 8)
            out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool)
            at += size
            return out

        occupied, run_end, counter = flags(1 << bits), flags(n), flags(n)
        size = max(-(-(width - bits) // 8), 4)
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
        return cls(width, bits, occupied, run_end, counter, slots.reshape(-1).view("<u8").astype(np.uint64))


def partition_filters(fingerprints: DataFrame, shard_bits: int = SHARD_BITS) -> DataFrame:
    """``(shard, filter)`` from a table of one long column: one filter per partition and shard."""
    width = 64 - shard_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        shards = (values >> np.uint64(width)).astype(np.int64)
        borders = np.searchsorted(shards, np.arange((1 << shard_bits) + 1))
        low = values & np.uint64((1 << width) - 1)
        for shard in np.unique(shards):
            part = slice(borders[shard], borders[shard + 1])
            body = QuotientFilter.build(low[part], counts[part], width).to_bytes()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard)], pa.int32()), "filter": pa.array([body], pa.binary())})

    return fingerprints.mapInArrow(build, "shard int, filter binary")


def repeated_fingerprints(filters: DataFrame, shard_bits: int = SHARD_BITS) -> DataFrame:
    """``(fingerprint, count)`` of every fingerprint that came more than once."""
    width = 64 - shard_bits

    def merge(shard: tuple, parts: pa.Table) -> pa.Table:
        merged = QuotientFilter.merge([QuotientFilter.from_bytes(x) for x in parts.column("filter").to_pylist()], width)
        values, counts = merged.items()
        many = counts > 1
        whole = (values[many] | np.uint64(shard[0].as_py() << width)).view(np.int64)
        return pa.table({"fingerprint": pa.array(whole, pa.int64()), "count": pa.array(counts[many], pa.int64())})

    return filters.groupBy("shard").applyInArrow(merge, "fingerprint long, count long")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_text, keep_id, group_size)``: one row per text that really repeats."""
    text = normalised(text_of(text_col))
    suspects = written(repeated_fingerprints(partition_filters(docs.select(F.xxhash64(text).alias("f")))), "repeated")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("fingerprint", F.xxhash64("_text"))
    found = rows.join(broadcast_if_counted(suspects), "fingerprint")
    # Byte comparison: grouped by the text itself. Copies fold inside each
    # partition, so a text with a third of all rows moves once per partition.
    groups = found.groupBy("_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.filter("group_size > 1")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns and ``_sha, _keep, _size, _kept``.

    Texts are equal when they agree after white space runs become one space;
    null counts as empty. Of equal texts the row with the smallest id stays;
    null ids come after all others. Rows that repeat id and text keep one.
    """
    groups = written(copy_groups(docs, id_col, text_col).select(
        F.sha2("_text", 256).alias("_gsha"), F.col("keep_id").alias("_keep_id"), "group_size"), "copies")
    rows = docs.withColumn("_sha", F.sha2(normalised(text_of(text_col)), 256))
    marked = rows.join(broadcast_if_counted(groups), F.col("_sha") == F.col("_gsha"), "left").select(
        *docs.columns, "_sha", F.when(F.col("_gsha").isNull(), F.col(id_col)).otherwise(F.col("_keep_id")).alias("_keep"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("_size"))
    kept = F.col(id_col).eqNullSafe(F.col("_keep"))
    again = written(docs.groupBy(F.col(id_col).alias("_again")).count().filter("count > 1"), "ids")
    if again.isEmpty():
        return marked.withColumn("_kept", kept)
    # Some ids repeat: of rows that share both id and text one stays.
    twins = kept & F.col("_twin").isNotNull() & (F.col("_size") > 1)
    flagged = marked.join(
        broadcast_if_counted(again.withColumn("_twin", F.lit(True))), F.col(id_col).eqNullSafe(F.col("_again")), "left")
    order = Window.partitionBy("_sha").orderBy(id_col)
    columns = [*marked.columns, "_kept"]
    single = flagged.filter(~twins).withColumn("_kept", kept).select(*columns)
    double = flagged.filter(twins).withColumn("_kept", F.row_number().over(order) == 1).select(*columns)
    return single.unionByName(double)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)``, one row per input row; see ``mark_copies``."""
    marked = mark_copies(docs.select(id_col, text_col), id_col, text_col)
    return marked.select(
        id_col, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return mark_copies(docs, id_col, text_col).filter("_kept").select(*docs.columns)
