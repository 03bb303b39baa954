"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Two texts link when the Jaccard similarity of their five-word shingle sets is
at least 0.8. Sets are put into size bands; a set also visits the next band
when a partner there is possible. In a band the domain of shingles is dealt
into more partitions than two linked sets can differ in shingles, so at least
one partition is equal in both. A signature is the hash of a set's part in one
partition. Empty parts are left out: a set with more filled partitions than
allowed differences still shares a filled one with every partner. The few sets
without that margin also sign their empty parts and so find each other.

A signature that many sets share is hot. Its sets link to one of them first. A
set that keeps its margin without its hot signatures has met every partner
elsewhere; only sets that lack that margin are looked at again, and only where
the first links have left them in different components. They meet on their
rarest shingles: of two similar sets, the first shingle they share stands so
early in both that the rest can still reach the similarity. Sets that share a
common passage and little else have it too late for that.

Equal sets are one node from the start. A candidate pair is first bounded from
above by small histograms of the two sets; what passes is verified on the whole
shingle sets, so the result is exact up to 64-bit hashes of shingles and sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.llm.common import automatic_joins, batches_of, broadcast_if_counted, same, slices, text_of, written
from sweepfield.plans.components import connected_components

GRAM, SIMILARITY = 5, 80  # words in a shingle; similarity in hundredths
# Partitions per shingle of the band's largest set, and the ratio of a band's ends.
PARTITIONS, BAND = 0.6, 1.5
# Sets that share a signature are paired with each other up to this many.
HOT = 16
SHARD_SIGNATURES = 700_000  # signatures that meet in one task
RUN_SIGNATURES = 400_000  # signatures that a task holds before it packs them
MET_PAIRS = 400_000  # pairs of short runs that a shard holds at once
SLICE_BYTES = 750_000  # text turned into shingles at once; the arrays take some fifty times as much
PAIR_BATCH = 1_000  # pairs that a task holds with both their sets
JOIN_BYTES = "256KB"  # tables that a join may broadcast by itself
ROUNDS = 3  # star rounds over hot signatures before the rest is paired

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_GAP = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 + salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(27))


def shingles(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, flat, and how many each text has.

    A text of fewer than ``gram`` words has its whole sequence as one shingle;
    one without words has none. Null counts as empty.
    """
    n = len(texts)
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, n + 1, whole.offset * 8)
    data = _LOWER[np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    solid = ~_GAP[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] |= solid[offsets[:-1][np.diff(offsets) > 0]]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = np.flatnonzero(solid)
    word = np.cumsum(first)[inside] - 1
    place = (inside - starts[word]).astype(np.uint64)
    heads = np.searchsorted(inside, starts)
    words = _mix(np.add.reduceat(_mix(data[inside].astype(np.uint64) | (place << np.uint64(8))), heads))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    # Short texts hash what they have; the number of words is part of the hash.
    size = np.minimum(counts, gram)
    each = np.where(counts > 0, np.maximum(counts - gram, 0) + 1, 0)
    text = np.repeat(np.arange(n), each)
    at = (ends - counts)[text] + np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    hashes = size[text].astype(np.uint64)
    for k in range(gram):
        there = k < size[text]
        hashes = np.where(there, _mix(hashes ^ words[np.minimum(at + k, len(words) - 1)], k), hashes)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))
    return hashes[fresh], np.bincount(text[fresh], minlength=n)


def _reduce(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values, zero for texts without any."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def node_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, independent of order."""
    return _mix(_reduce(_mix(hashes, 1), counts) ^ counts.astype(np.uint64))


def allowed(size: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Most shingles by which a set of this size differs from any partner."""
    largest = size * 100 // similarity
    return (size + largest) * (100 - similarity) // (100 + similarity)


def _bands(largest: int) -> list[int]:
    """Upper ends of the bands."""
    ends = [3]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND)))
    return ends


def signatures(hashes: np.ndarray, counts: np.ndarray, similarity: int = SIMILARITY):
    """``(row, signature)`` of all sets, and each set's margin.

    The margin says how many of its signatures a set may lose and still be
    sure to meet every partner; it is negative when it never was.
    """
    rows, found = [], []
    margin = np.full(len(counts), np.iinfo(np.int64).max)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), margin
    ends = np.array(_bands(int(counts.max())) + [int(counts.max()) * 2 + 2])
    own = np.searchsorted(ends, counts)
    row = np.repeat(np.arange(len(counts)), counts)
    places, parts = _mix(hashes, 2), _mix(hashes, 3)
    for visit in (False, True):
        band = own + visit
        upper = ends[np.minimum(band, len(ends) - 1)]
        joins = counts > 0
        if visit:  # only where a partner in the next band is possible
            joins &= counts * 100 // similarity > ends[own]
        # More partitions than two linked sets of the band can differ in.
        dealt = np.maximum(np.ceil(PARTITIONS * upper).astype(np.int64), allowed(upper, similarity) + 2)
        use = joins[row]
        part = (places[use] % dealt[row[use]].astype(np.uint64)).astype(np.int64)
        key = row[use] * (int(dealt.max()) + 1) + part
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            continue
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        mixed = np.add.reduceat(parts[use][order], heads)
        owner, slot = key[heads] // (int(dealt.max()) + 1), key[heads] % (int(dealt.max()) + 1)
        label = band[owner].astype(np.uint64) << np.uint64(40) | slot.astype(np.uint64)
        rows.append(owner)
        found.append(_mix(mixed ^ _mix(label, 4), 5))
        filled = np.bincount(owner, minlength=len(counts))
        spare = filled - allowed(counts, similarity) - 1
        margin = np.where(joins, np.minimum(margin, spare), margin)
        poor = np.flatnonzero(joins & (spare < 0))
        if len(poor):  # these sign their empty partitions too
            full = np.repeat(poor, dealt[poor])
            slots = np.arange(len(full)) - np.repeat(np.cumsum(dealt[poor]) - dealt[poor], dealt[poor])
            gone = ~np.isin(full * (int(dealt.max()) + 1) + slots, key[heads])
            label = band[full[gone]].astype(np.uint64) << np.uint64(40) | slots[gone].astype(np.uint64)
            rows.append(full[gone])
            found.append(_mix(_mix(label, 4), 5))
    return np.concatenate(rows), np.concatenate(found), margin


def histograms(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """How many shingles of each set fall into each of a power of two of buckets, about four in a bucket.

    Sets that share n shingles share at least n when buckets are compared, so
    the sum of the smaller counts bounds the intersection from above. A set
    with a count beyond one byte has no histogram and passes every bound.
    """
    out, ends = [], np.cumsum(counts)
    for end, n in zip(ends.tolist(), counts.tolist()):
        buckets = 1 << max(0, (n // 4).bit_length())
        seen = np.bincount((hashes[end - n:end] & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        out.append(seen.astype(np.uint8).tobytes() if n and seen.max() < 256 else b"")
    return out


def most_shared(a: bytes, b: bytes) -> float:
    """Upper bound of the shingles that two sets share, from their histograms."""
    if not a or not b:
        return math.inf
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    width = min(len(x), len(y))  # the longer one folds onto the shorter
    return int(np.minimum(x.reshape(-1, width).sum(axis=0), y.reshape(-1, width).sum(axis=0)).sum())


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp, n_shingles, node, margin, sketch)``, one row per input row; node is null for an empty set."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("fp"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE_BYTES)):
            hashes, counts = shingles(batch.column(2))
            node = pa.array(node_of(hashes, counts).view(np.int64), mask=counts == 0)
            _, _, margin = signatures(hashes, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), node, pa.array(margin, pa.int64()),
                 pa.array(histograms(hashes, counts), pa.binary())],
                names=["id", "fp", "n_shingles", "node", "margin", "sketch"])

    return rows.mapInArrow(run, "id long, fp long, n_shingles long, node long, margin long, sketch binary")


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.astype("<i8").tobytes() for a in arrays)


def _star(ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every member of a run with the run's first."""
    lead = np.repeat(ids[heads], sizes)
    far = ids != lead
    return lead[far], ids[far]


def _pairs_of(ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each run; runs are short."""
    left, right = [], []
    run = np.repeat(np.arange(len(heads)), sizes)
    for step in range(1, int(sizes.max(initial=0))):
        same = run[step:] == run[:-step]
        left.append(ids[:-step][same])
        right.append(ids[step:][same])
    return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller node first."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    fresh = np.append(np.ones(min(len(low), 1), bool), (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    return low[fresh], high[fresh]


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({
        "kind": pa.array(np.full(len(a), kind), pa.int32()), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


PAIR, MEMBER = 0, 1


def candidates(docs: DataFrame, text_col: str, shard_bits: int) -> DataFrame:
    """``(kind, a, b)``: candidate pairs of nodes, and members (signature, node) of hot signatures.

    A task signs its sets and packs the signatures, a bounded run at a time,
    into shards; members of signatures that are hot inside a run are kept as
    they are. A shard then meets the packed signatures of all runs. What one
    run gives a shard of one signature is bounded by HOT sets.
    """
    width = 64 - shard_bits
    kept_bits = min(width, 48)
    low_mask = np.uint64((1 << kept_bits) - 1)
    rows = docs.select(text_of(text_col).alias("t"))

    def name_of(key: np.ndarray) -> np.ndarray:
        """A signature as the shards know it: shard and kept bits."""
        return (key >> np.uint64(width) << np.uint64(kept_bits)) | (key & low_mask)

    def packed(node: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One run of signatures, sorted, a row per shard that it fills."""
        order = np.argsort(key, kind="stable")
        node, key = node[order], key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        hot = sizes > HOT
        inside = np.repeat(hot, sizes)
        # Hot here: members stay as they are, one of them stands for all.
        shown = ~inside
        shown[heads] = True
        flag = inside[shown]
        hot_key, hot_node = name_of(key[inside]), node[inside]
        left, right = _distinct(*_star(hot_node, np.cumsum(sizes[hot]) - sizes[hot], sizes[hot]))
        node, key = node[shown], key[shown]
        shard, low = (key >> np.uint64(width)).astype(np.int64), key & low_mask
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        borders = np.append(starts, len(shard))
        # Members and pairs may travel with any shard.
        spread = np.linspace(0, len(hot_key), len(starts) + 1).astype(int)
        dealt = np.linspace(0, len(left), len(starts) + 1).astype(int)
        for s in range(len(starts)):
            part, extra, linked = slice(borders[s], borders[s + 1]), slice(spread[s], spread[s + 1]), slice(dealt[s], dealt[s + 1])
            by_node = np.argsort(node[part], kind="stable")
            own, own_low, own_flag = node[part][by_node], low[part][by_node], flag[part][by_node]
            lead_at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard[borders[s]]], pa.int64()),
                "nodes": pa.array([own[lead_at].astype("<u8").tobytes()], pa.binary()),
                "counts": pa.array([np.diff(np.append(lead_at, len(own))).astype("<u4").tobytes()], pa.binary()),
                "keys": pa.array([own_low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()], pa.binary()),
                "flags": pa.array([np.packbits(own_flag).tobytes()], pa.binary()),
                "members": pa.array([_pack(hot_key[extra].view(np.int64), hot_node[extra].view(np.int64))], pa.binary()),
                "pairs": pa.array([_pack(left[linked].view(np.int64), right[linked].view(np.int64))], pa.binary()),
            })

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, signed, held = [], [], [], 0
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            hashes, counts = shingles(batch.column(0))
            node = node_of(hashes, counts)
            fresh = np.zeros(len(counts), bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            fresh &= counts > 0
            for known in signed:  # sets of this run
                fresh &= ~np.isin(node, known)
            hashes, node, counts = hashes[np.repeat(fresh, counts)], node[fresh], counts[fresh]
            row, key, _ = signatures(hashes, counts)
            signed.append(node)
            nodes.append(node[row])
            keys.append(key)
            held += len(key)
            if held >= RUN_SIGNATURES:
                yield from packed(np.concatenate(nodes), np.concatenate(keys))
                nodes, keys, signed, held = [], [], [], 0
        if held:
            yield from packed(np.concatenate(nodes), np.concatenate(keys))

    def meet(shard: tuple, parts: pa.Table) -> pa.Table:
        nodes, keys, flags, out = [], [], [], []
        columns = [parts.column(c) for c in ("nodes", "counts", "keys", "flags", "members", "pairs")]
        for at in range(parts.num_rows):
            own, counts, low_bytes, flag_bits, members, pairs = (c[at].as_py() for c in columns)
            counts = np.frombuffer(counts, "<u4").astype(np.int64)
            total = int(counts.sum())
            low = np.zeros((total, 8), np.uint8)
            low[:, :6] = np.frombuffer(low_bytes, np.uint8).reshape(total, 6)
            nodes.append(np.repeat(np.frombuffer(own, "<u8"), counts))
            keys.append(low.reshape(-1).view("<u8"))
            flags.append(np.unpackbits(np.frombuffer(flag_bits, np.uint8), count=total).astype(bool))
            for kind, raw in ((MEMBER, members), (PAIR, pairs)):
                if raw:
                    both = np.frombuffer(raw, "<i8").view(np.uint64)
                    out.append(_found(kind, both[:len(both) // 2], both[len(both) // 2:]))
        node, key, flag = np.concatenate(nodes), np.concatenate(keys), np.concatenate(flags)
        del nodes, keys, flags
        order = np.lexsort((node, key))
        node, key, flag = node[order], key[order], flag[order]
        again = np.append(False, (key[1:] == key[:-1]) & (node[1:] == node[:-1]))
        # A set that several runs signed counts once, hot if it was hot anywhere.
        lead_at = np.flatnonzero(~again)
        flag = np.logical_or.reduceat(flag, lead_at)
        node, key = node[lead_at], key[lead_at]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        hot = (sizes > HOT) | np.logical_or.reduceat(flag, heads)
        # Short runs are paired in full, so many of them at a time that their pairs stay bounded.
        few = np.flatnonzero((sizes > 1) & ~hot)
        group = np.cumsum(sizes[few] * (sizes[few] - 1) // 2) // MET_PAIRS
        for part in np.split(few, np.flatnonzero(group[1:] != group[:-1]) + 1):
            kept = sizes[part]
            members = np.repeat(heads[part] - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
            out.append(_found(PAIR, *_distinct(*_pairs_of(node[members], np.cumsum(kept) - kept, kept))))
        inside, kept = np.repeat(hot, sizes), sizes[hot]
        if len(kept):
            out.append(_found(PAIR, *_distinct(*_star(node[inside], np.cumsum(kept) - kept, kept))))
            whole = (np.uint64(shard[0].as_py()) << np.uint64(kept_bits)) | key[inside]
            out.append(_found(MEMBER, whole, node[inside]))
        return pa.concat_tables(out) if out else _found(PAIR, node[:0], node[:0])

    schema = "shard long, nodes binary, counts binary, keys binary, flags binary, members binary, pairs binary"
    return rows.mapInArrow(sign, schema).groupBy("shard").applyInArrow(meet, "kind int, a long, b long")


def shingle_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """``(node, hashes)``: each distinct set once per partition, its hashes sorted and packed."""
    rows = docs.select(text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            hashes, counts = shingles(batch.column(0))
            node = node_of(hashes, counts)
            fresh = np.zeros(len(counts), bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            fresh &= ~np.isin(node, known) & (counts > 0)
            known = np.append(known, node[fresh])
            data = hashes[np.repeat(fresh, counts)].astype("<u8").tobytes()
            ends = np.append(0, np.cumsum(counts[fresh])) * 8
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(node[fresh].view(np.int64)), packed], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def _sets_of(docs: DataFrame, text_col: str, needed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the sets in ``needed(node)``; only texts of these are read into sets and moved.

    Texts whose 64-bit hashes clash may add a set that nobody asked for.
    """
    texts = broadcast_if_counted(written(needed.join(nodes, "node").select("node", "fp"), "nodes"))
    own = docs.select(text_of(text_col).alias("t"))
    own = own.join(texts.select("fp"), F.xxhash64("t") == F.col("fp"), "left_semi")
    return shingle_sets(own, "t").groupBy("node").agg(F.first("hashes").alias("hashes"))


def rarest_pairs(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``(a, b)``: distinct pairs of ``sets(node, size, label, hashes)`` with different labels that can reach the similarity.

    Shingles stand in one order in all sets, rare ones first. Two sets share no
    more than what follows their first common shingle in either, itself
    included; so it stands among the first ninth of the smaller set and the
    first fifth of the larger one (at 80 hundredths), and both rests are long
    enough for the two sizes. Every similar pair passes there.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3, 4 * SLICE_BYTES)):
            counts = pc.binary_length(batch.column(3)).to_numpy() // 8
            own = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            found = np.concatenate([np.frombuffer(v.as_buffer(), "<i8") for v in batch.column(3)])
            yield pa.RecordBatch.from_arrays([batch.column(k).take(own) for k in range(3)] + [pa.array(found)], names=["node", "size", "label", "sig"])

    rows = written(sets.select("node", "size", "label", "hashes").mapInArrow(flat, "node long, size long, label long, sig long"), "shingles")
    # A shingle of one set alone takes a place before all others; one of a single component leads to no pair.
    shared = rows.groupBy("sig").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("_l"), F.max("label").alias("_h")).filter("n > 1").select(
        "sig", "n", (F.col("_l") < F.col("_h")).alias("mixed"))
    own = Window.partitionBy("node")
    placed = rows.join(shared, "sig").withColumn("_k", F.row_number().over(own.orderBy("n", "sig"))).withColumn(
        "_shared", F.count(F.lit(1)).over(own)).withColumn("rest", F.col("_shared") - F.col("_k") + 1)
    # rest: shingles from this one on.
    early = written(placed.filter(F.col("mixed") & (100 * F.col("rest") >= similarity * F.col("size"))).select(
        "sig", "node", "size", "label", "rest"), "early")
    small = early.filter((100 + similarity) * F.col("rest") >= 2 * similarity * F.col("size")).select(
        "sig", F.col("node").alias("a"), F.col("size").alias("x"), F.col("label").alias("l"), F.col("rest").alias("r"))
    large = early.select("sig", F.col("node").alias("b"), F.col("size").alias("y"), F.col("label").alias("m"), F.col("rest").alias("t"))
    may = (F.col("l") != F.col("m")) & ((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("a") < F.col("b"))))
    may = may & ((100 + similarity) * F.least("r", "t") >= similarity * (F.col("x") + F.col("y")))
    return small.join(large, "sig").filter(may).select("a", "b").distinct()


def verified(docs: DataFrame, text_col: str, pairs: DataFrame, nodes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the similarity.

    Only texts of sets that occur in a pair are read into sets and moved. Each
    pair carries one set to the other, so a task holds a batch of pairs at a time.
    """
    sets = _sets_of(docs, text_col, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes)
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("s")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("t")), "b").select("a", "b", "s", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
                shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                hit[i] = 100 * shared >= similarity * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit)), batch.column(1).filter(pa.array(hit))], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose sizes and histograms allow the similarity."""
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("x"), F.col("sketch").alias("s"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("y"), F.col("sketch").alias("t"))
    close = 100 * F.least("x", "y") >= similarity * F.greatest("x", "y")
    both = pairs.join(left, "a").join(right, "b").filter(close).select("a", "b", "x", "y", "s", "t")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = np.array([most_shared(s.as_py(), t.as_py()) for s, t in zip(batch.column(4), batch.column(5))])
            # shared / (sizes - shared) >= similarity, with the bound in place of shared
            may = pa.array((100 + similarity) * most >= similarity * sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(may), batch.column(1).filter(may)], names=["a", "b"])

    return both.mapInArrow(bound, "a long, b long")


def _components(edges: DataFrame) -> DataFrame:
    links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return connected_components(links.select(F.col("a").alias("node")).distinct(), links)


def _relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further edges: only the labels that these edges touch are joined anew."""
    own = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
    ends = more.join(own, F.col("a") == F.col("n"), "left").select("b", F.coalesce("l", "a").alias("x")).join(
        own, F.col("b") == F.col("n"), "left").select("x", F.coalesce("l", "b").alias("y")).filter("x <> y").distinct()
    links = written(ends.union(ends.select("y", "x")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    tops = connected_components(links.select(F.col("a").alias("node")).distinct(), links).select(
        F.col("node").alias("old"), F.col("label").alias("new"))
    fresh = more.select("a").union(more.select("b")).distinct().join(own, F.col("a") == F.col("n"), "left_anti").select(
        F.col("a").alias("node"), F.col("a").alias("label"))
    known = labels.select("node", "label").unionByName(fresh)
    return written(known.join(broadcast_if_counted(tops), F.col("label") == F.col("old"), "left").select(
        "node", F.coalesce("new", "label").alias("label")), "relabelled")


def _link_nodes(docs: DataFrame, nodes: DataFrame, text_col: str, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    total = nodes.agg(F.sum("size")).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, total / SHARD_SIGNATURES))))
    found = written(candidates(docs, text_col, bits), "candidates")
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = written(_possible(pair(found.filter(F.col("kind") == PAIR)), nodes, similarity), "pairs")
    edges = written(verified(docs, text_col, tried, nodes, similarity), "edges")
    labels = _components(edges)
    # Sets that lost their margin to hot signatures meet there once more.
    hot = found.filter(F.col("kind") == MEMBER).select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct()
    lost = hot.groupBy("node").agg(F.count(F.lit(1)).alias("lost"))
    unsafe = lost.join(nodes, "node").filter("lost > margin").select(
        "node", "size", (F.col("lost") - F.greatest("margin", F.lit(0))).alias("head"))
    # A pair not met elsewhere agrees on hot signatures alone, on more than the
    # margin of either set. So it shares one among the rarest ``head`` of both.
    rare = Window.partitionBy("node").orderBy("n", "sig")
    ranked = hot.join(unsafe, "node").join(hot.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sig")
    rest = written(ranked.withColumn("_rank", F.row_number().over(rare)).filter("_rank <= head").select("sig", "node", "size"), "unsafe")
    for turn in range(ROUNDS + 1):
        own = rest.join(labels, "node", "left").select("sig", "node", "size", F.coalesce("label", "node").alias("label"))
        mixed = own.groupBy("sig").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).filter("_l < _h").select("sig")
        rest_now = written(own.join(mixed, "sig"), "open")
        if rest_now.isEmpty():
            break
        if turn < ROUNDS:
            # One set of the largest component stands for it; the others of the signature try it.
            parts = rest_now.groupBy("sig", "label").agg(
                F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("centre"))
            lead = parts.groupBy("sig").agg(F.max_by(F.struct("label", "centre"), F.struct("n", "label")).alias("m"))
            met = rest_now.join(lead, "sig").filter(F.col("label") != F.col("m.label")).select(F.col("node").alias("a"), F.col("m.centre").alias("b"))
        else:
            # What is still apart meets on its rarest shingles.
            apart = written(rest_now.select("node", "size", "label").distinct(), "apart")
            met = rarest_pairs(apart.join(_sets_of(docs, text_col, apart.select("node"), nodes), "node"), similarity)
        fresh = written(_possible(pair(met), nodes, similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            continue
        more = written(verified(docs, text_col, fresh, nodes, similarity), "edges")
        tried = tried.union(fresh)
        if not more.isEmpty():
            edges = edges.union(more)
            labels = _relabelled(labels, more)
    return edges, labels


def link_nodes(docs: DataFrame, nodes: DataFrame, text_col: str, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified edges between nodes and the label of every node that has one; ``nodes(node, size, margin, fp, sketch)``."""
    with batches_of(docs.sparkSession, PAIR_BATCH), automatic_joins(docs.sparkSession, JOIN_BYTES):
        return _link_nodes(docs, nodes, text_col, similarity)


def components_of(docs: DataFrame, id_col: str, text_col: str, similarity: int = SIMILARITY) -> DataFrame:
    """``(id, fp, n_shingles, links, low)``, one row per input row.

    ``fp`` is the text's hash; ``low`` is the (id, fp) of the component's
    first row, null for rows that link with nothing.
    """
    who = written(members(docs, id_col, text_col), "members")
    nodes = written(who.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("n_shingles").alias("size"), F.first("margin").alias("margin"), F.min("fp").alias("fp"), F.first("sketch").alias("sketch")), "sets")
    edges, labels = link_nodes(docs, nodes, text_col, similarity)
    ends = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    linked = written(labels.join(ends, "node", "left").select("node", "label", "links"), "labels")
    placed = who.join(broadcast_if_counted(linked), "node", "left").select(
        "id", "fp", "n_shingles", F.coalesce("label", "node").alias("_set"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    # Null ids come after all others.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp"))
    lowest = written(placed.filter("_set IS NOT NULL").groupBy("_set").agg(first.alias("_f"), F.count(F.lit(1)).alias("_n")).filter(
        "_n > 1").select(F.col("_set").alias("_s"), F.struct("_f.id", "_f.fp").alias("low")), "lowest")
    return placed.join(broadcast_if_counted(lowest), F.col("_set") == F.col("_s"), "left").select("id", "fp", "n_shingles", "links", "low")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """``(id_col, n_shingles, component_id, links)``, one row per input row.

    ``component_id`` is the smallest id reachable by links, the row's own
    included; ``links`` counts the other distinct sets the row's set was
    verified against with success, which is a lower bound of its links inside
    large components. Null and empty texts have no shingles and link with
    nothing. Null ids count as the largest; repeated rows share a component.
    Other columns are dropped; ids are whole numbers.
    """
    found = components_of(docs, id_col, text_col, similarity)
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("low.id", "id").alias("component_id"), "links")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """The rows that stay, all columns kept: one document of each component, the one with the smallest id.

    Rows that share id and text are one document. Texts without words all stay.
    """
    found = components_of(docs, id_col, text_col, similarity)
    gone = written(found.filter(F.col("low").isNotNull() & ~same([(F.col("id"), F.col("low.id")), (F.col("fp"), F.col("low.fp"))])).select(
        F.col("id").alias("_gone"), F.col("fp").alias("_gone_fp")).distinct(), "near")
    rows = docs.withColumn("_own_fp", F.xxhash64(text_of(text_col)))
    hit = same([(F.col(id_col).cast("long"), F.col("_gone")), (F.col("_own_fp"), F.col("_gone_fp"))])
    return rows.join(broadcast_if_counted(gone), hit, "left_anti").select(*docs.columns)
