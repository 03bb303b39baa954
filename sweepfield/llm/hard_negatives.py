"""Hard-negative mining over rotated one-bit codes.

Every vector u, after one fixed rotation, keeps the signs s of its coordinates
as a code, and beside it its alignment with that code vector: a with
``u = a s + r`` and r orthogonal to s. For an anchor v with bit planes

    <u, v> = a <s, v> + <r, v>,    |<r, v>| <= |r| * |v without its part along s|

where <s, v> comes from popcounts of the code against the anchor's planes, and
what the planes leave out is bounded by Cauchy-Schwarz too. So each estimate has
an interval that the true score cannot leave. An interval that could still
matter is scored with integers; all others are done. The result is exact.

Vectors and anchors are held in blocks. A block of anchors meets every block of
vectors; a task keeps only the best few rows per anchor it has met, which also
raise the bar for later blocks, and Spark ranks what the tasks report.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.llm.common import written

POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # bounds of a negative's score in hundredths of the positive's
SCALE = 256
ROWS, ANCHORS = 2048, 512  # vectors and anchors in a block
PLANES = 8  # bits of an anchor's coordinates
SEED = 12
GROUP_BLOCKS, GROUP_BYTES = 64, 32_000_000  # anchor blocks that meet a block of vectors in one task
HELD = 128  # anchor blocks whose best rows a task keeps at a time
EXACT = 2.0**52  # integers below this are exact in doubles
NONE = np.iinfo(np.int64).min
BLOCK = "block long, n int, dims int, ids binary, labels binary, values binary"
CODED = BLOCK + ", codes binary, align binary, rest binary, norms binary"


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """The same orthogonal matrix everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    packed = np.packbits(signs, axis=1)
    wide = np.zeros((len(signs), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def code(values: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment, length of the rest, and norm of each vector."""
    turned = values @ turn
    signs = turned > 0
    align = np.abs(turned).sum(axis=1) / max(1, turned.shape[1])
    norms = np.sqrt((turned**2).sum(axis=1))
    rest = np.sqrt(np.maximum(norms**2 - align**2 * turned.shape[1], 0))
    return _bits(signs), align, rest, norms


class Anchors:
    """A block of anchors, ready to be estimated against: bit planes of the rotated vectors and what they leave out."""

    def __init__(self, values: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        turned = values @ turn
        self.dims = turned.shape[1]
        self.values, self.norms = values, np.sqrt((turned**2).sum(axis=1))
        low = turned.min(axis=1, initial=0)
        step = (turned.max(axis=1, initial=0) - low) / (2**planes - 1)
        step[step == 0] = 1
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        self.low, self.step = low, step
        self.planes = [_bits((level >> b & 1).astype(bool)) for b in range(planes)]
        shown = low[:, None] + step[:, None] * level
        self.total = shown.sum(axis=1)
        self.missing = np.sqrt(((turned - shown) ** 2).sum(axis=1))

    def interval(self, codes: np.ndarray, align: np.ndarray, rest: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of every vector with every anchor."""
        n, m = len(codes), len(self.norms)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        hits = np.zeros((n, m))
        for b, plane in enumerate(self.planes):
            for word in range(codes.shape[1]):
                hits += np.bitwise_count(codes[:, word, None] & plane[None, :, word]).astype(np.float64) * 2.0**b
        # <s, v> with s = 2 bits - 1
        along = 2 * (self.step * hits + self.low * ones[:, None]) - self.total
        slack = np.sqrt(self.dims) * self.missing
        across = np.sqrt(np.maximum(self.norms**2 - np.maximum(np.abs(along) - slack, 0) ** 2 / max(1, self.dims), 0))
        middle = align[:, None] * along
        half = align[:, None] * slack + rest[:, None] * across
        half += 1e-7 * (norms[:, None] * self.norms + 1)  # rounding of the doubles above, roots of cancelled squares included
        return middle - half, middle + half


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; through doubles where those are exact."""
    most = np.abs(left).max(initial=0) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < EXACT:
        return np.rint(left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _best(ids: np.ndarray, points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -points))[:count]
    return ids[order], points[order]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, values array<long>)`` of the rows that take part, components scaled and floored.

    Rows without id, label or vector and rows with a null or non-finite
    component take no part.
    """
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x * SCALE)).alias("values"))


def _padded(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists as a matrix; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def blocks(rows: DataFrame, dims: int, size: int, coded: bool) -> DataFrame:
    """Rows of ``usable`` packed, up to ``size`` a block; coded with their one-bit codes, else as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, turn = TaskContext.get().partitionId() << 32, rotation(dims)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                values = _padded(part.column(2), dims)
                columns = [part.column(0).to_numpy().astype("<i8"), part.column(1).to_numpy().astype("<i8"), values.astype("<i8")]
                if coded:
                    columns += code(values.astype(np.float64), turn)
                kept = [pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int32()), pa.array([dims], pa.int32())]
                kept += [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]
                names = [field.split()[0] for field in (CODED if coded else BLOCK).split(", ")]
                yield pa.RecordBatch.from_arrays(kept, names=names)
                number += 1

    return rows.select("id", "label", "values").mapInArrow(run, CODED if coded else BLOCK)


def _numbers(raw: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(shape)


def _meeting(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of vectors beside each block of anchors.

    Anchor blocks are dealt into groups that a task can hold. One group is
    broadcast, its size being counted; more of them are joined by shuffles, a
    block of vectors going once to each group and a group to as many keys as
    there are shuffle partitions.
    """
    named = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    count, size = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("values")), F.lit(0))).first()
    groups = max(1, math.ceil(count / GROUP_BLOCKS), math.ceil(size / GROUP_BYTES))
    dealt = named.withColumn("_g", F.pmod(F.xxhash64("a_block"), F.lit(groups)).cast("int"))
    each = vectors.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if groups == 1:
        return each.join(F.broadcast(dealt), "_g").drop("_g")
    keys = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))))
    return each.withColumn("_s", F.pmod(F.xxhash64("block"), F.lit(keys)).cast("int")).join(dealt, ["_g", "_s"]).drop("_g", "_s")


class _Held:
    """The best rows of each place of an anchor block that a task has met so far."""

    def __init__(self, places: int, count: int):
        self.ids, self.points = np.zeros((places, count), np.int64), np.full((places, count), NONE)

    def bar(self) -> np.ndarray:
        """Score that a further row has to reach in each place."""
        return self.points[:, -1]

    def add(self, place: int, ids: np.ndarray, points: np.ndarray):
        have = self.points[place] != NONE
        ids, points = _best(np.append(self.ids[place][have], ids), np.append(self.points[place][have], points), self.points.shape[1])
        self.ids[place, :len(ids)], self.points[place, :len(ids)] = ids, points

    def rows(self, block: int) -> pa.RecordBatch:
        place, at = np.nonzero(self.points != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(place), block), pa.int64()), pa.array(place, pa.int32()), pa.array(self.ids[place, at]),
             pa.array(self.points[place, at])], names=["block", "place", "id", "score"])


FOUND = "block long, place int, id long, score long"


def _scan(pairs: DataFrame, turn_dims: int, visit, places_per_anchor: int, count: int) -> DataFrame:
    """Best rows per place of each anchor block; ``visit(row, anchors, held, interval, vectors)`` adds what a meeting brings."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, ready = rotation(turn_dims), {}, {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in names}
                block, m = row["a_block"], row["a_n"]
                if block not in held:
                    if len(held) >= HELD:
                        old = next(iter(held))
                        yield held.pop(old).rows(old)
                        ready.pop(old)
                    held[block] = _Held(m * places_per_anchor, count)
                    ready[block] = Anchors(_numbers(row["a_values"], "<i8", m, row["a_dims"]).astype(np.float64), turn)
                n, anchors = row["n"], ready[block]
                codes = _numbers(row["codes"], "<u8", n, -1)
                floats = [_numbers(row[c], "<f8", n) for c in ("align", "rest", "norms")]
                visit(row, anchors, held[block], anchors.interval(codes, *floats), _numbers(row["values"], "<i8", n, row["dims"]))
        for block, kept in held.items():
            yield kept.rows(block)

    return pairs.mapInArrow(run, FOUND)


def _settle(mask: np.ndarray, vectors: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and integer score of the pairs in ``mask``, anchor by anchor."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    points = scores(vectors[rows], anchors[cols])
    at, to = np.nonzero(mask[np.ix_(rows, cols)].T)
    return rows[to], cols[at], points[to, at]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]))


def _positive(row, anchors: Anchors, held: _Held, interval, vectors):
    """Rows of the anchor's label, the anchor's own id left out."""
    low, high = interval
    ids, labels = (_numbers(row[c], "<i8", row["n"]) for c in ("ids", "labels"))
    a_ids, a_labels = (_numbers(row[f"a_{c}"], "<i8", row["a_n"]) for c in ("ids", "labels"))
    same = (labels[:, None] == a_labels) & (ids[:, None] != a_ids)
    count = held.points.shape[1]
    bar = held.bar().astype(np.float64)
    sure = np.where(same, low, -np.inf)
    if len(ids) > count:  # as many rows certainly reach this
        bar = np.maximum(bar, np.partition(sure, len(ids) - count, axis=0)[len(ids) - count])
    mine, anchor, points = _settle(same & (high >= bar), vectors, _numbers(row["a_values"], "<i8", row["a_n"], row["a_dims"]))
    for a, b in _runs(anchor):
        held.add(int(anchor[a]), ids[mine[a:b]], points[a:b])


def _negative(lowest: int, highest: int, positives: int):
    def visit(row, anchors: Anchors, held: _Held, interval, vectors):
        """Rows of other labels inside each positive's range of scores."""
        low, high = interval
        ids, labels = (_numbers(row[c], "<i8", row["n"]) for c in ("ids", "labels"))
        m = row["a_n"]
        a_labels, goal = _numbers(row["a_labels"], "<i8", m), _numbers(row["a_goals"], "<i8", m, positives)
        least, most, some = _ranges(goal, lowest, highest)
        other, count = labels[:, None] != a_labels, held.points.shape[1]
        bars = np.maximum(held.bar().reshape(m, positives), least).astype(np.float64)
        open_pairs = np.zeros(other.shape, bool)
        for k in range(positives):
            inside = other & some[:, k] & (low <= most[:, k])
            bar = bars[:, k]
            if len(ids) > count:
                sure = np.where(inside & (high <= most[:, k]) & (low >= least[:, k]), low, -np.inf)
                bar = np.maximum(bar, np.partition(sure, len(ids) - count, axis=0)[len(ids) - count])
            open_pairs |= inside & (high >= bar)
        mine, anchor, points = _settle(open_pairs, vectors, _numbers(row["a_values"], "<i8", m, row["a_dims"]))
        for a, b in _runs(anchor):
            to, own, got = int(anchor[a]), ids[mine[a:b]], points[a:b]
            for k in range(positives):
                if some[to, k]:
                    fit = (got >= max(least[to, k], held.points[to * positives + k, -1])) & (got <= most[to, k])
                    if fit.any():
                        held.add(to * positives + k, own[fit], got[fit])

    return visit


def _ranges(goal: np.ndarray, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and most integer score with ``lowest * goal <= 100 * score <= highest * goal``, and where there is any."""
    some = goal != NONE
    safe = np.where(some, goal, 0)
    least, most = -(-(lowest * safe) // 100), (highest * safe) // 100
    return least, most, some & (least <= most)


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def mine(
    vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor(id)`` is a condition on the id column. Anchors are paired with
    their best ``positives`` rows of the same label, and each such pair with
    the best ``negatives`` rows of other labels whose score lies between
    ``lowest`` and ``highest`` hundredths of the positive's. Higher scores come
    first, smaller ids among equals. An anchor without positives, and a
    positive without such rows, give no rows. Rows with nulls or non-finite
    components take no part. Repeated rows count each; "other" rows have another
    id than the anchor. Shorter vectors count as ending in zeros. Scores
    beyond 63 bits are not defined. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = written(usable(vectors, id_col, vector_col, label_col), "vectors")
    dims = max(1, rows.agg(F.max(F.size("values"))).first()[0] or 1)
    coded = written(blocks(rows, dims, ROWS, True), "codes")
    wanted = rows.filter(is_anchor(F.col("id")))
    parts = math.ceil(wanted.count() / (8 * ANCHORS))
    packed = written(blocks(wanted.repartition(max(1, parts)), dims, ANCHORS, False), "anchors")
    found = _ranked(_scan(_meeting(coded, packed), dims, _positive, 1, positives), positives)
    pairs = written(found.select("block", "place", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    goals = pairs.groupBy("block").agg(F.collect_list(F.struct("place", "slot", "positive_score")).alias("goals"))
    with_goals = written(_goals(packed.join(goals, "block"), positives), "goals")
    rest = _ranked(_scan(_meeting(coded, with_goals), dims, _negative(lowest, highest, positives), positives, negatives), negatives)
    own = rest.select("block", (F.col("place") % positives + 1).cast("int").alias("slot"), F.floor(F.col("place") / positives).cast("int").alias("place"),
                      F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = _names(packed)
    return own.join(pairs, ["block", "place", "slot"]).join(names, ["block", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _names(packed: DataFrame) -> DataFrame:
    """``(block, place, anchor_id)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[at].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), batch.column("block")[at].as_py()), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)],
                    names=["block", "place", "anchor_id"])

    return packed.select("block", "ids").mapInArrow(run, "block long, place int, anchor_id long")


def _goals(packed: DataFrame, positives: int) -> DataFrame:
    """Anchor blocks with the scores of their positives, ``NONE`` where there are fewer; a block's list is bounded by its size."""
    names = [field.split()[0] for field in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                goal = np.full((batch.column("n")[at].as_py(), positives), NONE)
                for g in batch.column("goals")[at].as_py():
                    goal[g["place"], g["slot"] - 1] = g["positive_score"]
                out.append(goal.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, "goals"])

    return packed.select(*names, "goals").mapInArrow(run, BLOCK + ", goals binary")
