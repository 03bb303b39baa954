"""Detection boxes: overlap, suppression, merging and order.

Axis-aligned tables hold ``image_id, box_id, x0, y0, x1, y1, score``; quads
hold ``x1 y1 … x4 y4``. Suppression and merging take either.

Overlapping boxes meet on a grid of levels, each box on the level of its own
size, so a large box meets small ones once and small ones don't meet in its
cells. Boxes of an image with few of them meet directly. Suppression walks
through such an image in its task; in crowded images it works on the overlaps
alone, found once: rounds settle all boxes that outrank what they overlap.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepfield.functions.numeric import is_finite
from sweepfield.plans import blocks
from sweepfield.plans.blocks import fold_in_blocks, in_blocks
from sweepfield.plans.folds import Columns, fold_groups
from sweepfield.plans.ordered import Spans, ensure_spans, with_position
from sweepfield.session import shared_folder

IMAGE = ["image_id"]
SIDES = ["x0", "y0", "x1", "y1"]
# Quads clipped in doubles overlap by more than their rounding.
TOUCHING = 1e-9
# Up to this many boxes an image is treated in one go: all its pairs fit into a task many times.
CROWD = 256


def _cells(boxes: DataFrame, level: Column) -> DataFrame:
    """Repeat each box for every cell of the level that it covers: as sides are at most a cell long, four at most."""
    at = lambda side: F.floor(F.col(side) / F.pow(F.lit(2.0), level)).cast("long")
    wide = boxes.select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("cell_x"))
    return wide.select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("cell_y"))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Area shared by two boxes given as four columns each."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def area(a: list[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: list[Column], b: list[Column]) -> Column:
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when(union == 0, 0.0).otherwise(F.try_divide(shared, union))


def _side(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{s}") for s in SIDES]


def iou_pairs(boxes: DataFrame, above: float = 0.0) -> DataFrame:
    """Pairs of overlapping boxes of an image with IoU above the limit.

    Boxes of an image with up to ``CROWD`` of them are joined directly. In a
    larger one a box stands in the cells of its own level and looks at the
    cells that it covers on each level above that its image has; a pair counts
    in the cell of its overlap's lower corner only. ``iog`` is the overlap over
    the second box's area, ``box_a`` the smaller id.
    """
    return _met(boxes, above).select(*IMAGE, "box_a", "box_b", "iou", "iog")


def _met(boxes: DataFrame, above: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of ``iou_pairs`` with ``carried`` columns of both boxes as ``…_a`` and ``…_b``."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    rows = boxes.select(*IMAGE, "box_id", *SIDES, *carried, F.ceil(F.log2(side)).cast("int").alias("own"))
    name = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("box_id", *SIDES, *carried, "own")]
    levels = rows.groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("own").alias("levels"))
    sized = rows.join(levels, IMAGE)
    few = sized.filter(F.col("_n") <= CROWD)
    shares = F.expr("a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    near = few.select(*IMAGE, *name("a_")).join(few.select(*IMAGE, *name("b_")), IMAGE).filter((F.col("a_box_id") < F.col("b_box_id")) & shares)
    many = sized.filter(F.col("_n") > CROWD)
    grid = [*IMAGE, "level", "cell_x", "cell_y"]
    above_own = F.filter("levels", lambda v: v >= F.col("own"))
    looking = many.withColumn("level", F.explode(above_own))
    small = _cells(looking, F.col("level")).select(*grid, *name("a_"))
    large = _cells(many.withColumn("level", F.col("own")), F.col("level")).select(*grid, *name("b_"))
    once = (F.col("a_own") < F.col("b_own")) | (F.col("a_box_id") < F.col("b_box_id"))
    home = lambda axis: F.floor(F.greatest(f"a_{axis}0", f"b_{axis}0") / F.pow(F.lit(2.0), F.col("level")))
    met = small.join(large, grid).filter(
        once & (F.col("a_box_id") != F.col("b_box_id")) & (home("x") == F.col("cell_x")) & (home("y") == F.col("cell_y")))
    met = near.unionByName(met.filter(shares).select(near.columns))
    first = F.col("a_box_id") < F.col("b_box_id")
    pick = lambda c, smaller: F.when(first == F.lit(smaller), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    a, b = ([pick(c, smaller) for c in SIDES] for smaller in (True, False))
    return met.select(
        *IMAGE, pick("box_id", True).alias("box_a"), pick("box_id", False).alias("box_b"), iou(a, b).alias("iou"),
        F.when(area(b) == 0, 0.0).otherwise(F.try_divide(overlap(a, b), area(b))).alias("iog"),
        *[pick(c, smaller).alias(f"{c}_{p}") for c in carried for p, smaller in (("a", True), ("b", False))],
    ).filter(F.col("iou") > above)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _quad_area(quads: np.ndarray) -> np.ndarray:
    """Signed areas of an (n, 4, 2) array of quads."""
    x, y = quads[:, :, 0], quads[:, :, 1]
    return ((x * np.roll(y, -1, axis=1)).sum(axis=1) - (y * np.roll(x, -1, axis=1)).sum(axis=1)) / 2


def _shared_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Overlap areas of two stacks of convex quads, as a boundary integral.

    The overlap's border is made of the stretches of each quad's edges inside
    the other quad. Edges that coincide count once, and only in one direction.
    """
    turned = lambda s: np.where((_quad_area(s) < 0)[:, None, None], s[:, ::-1], s)
    p, q = turned(p), turned(q)
    total = np.zeros(len(p))
    for edges, window, second in ((p, q, False), (q, p, True)):
        for i in range(4):
            a, b = edges[:, i], edges[:, (i + 1) % 4]
            start, stop = np.zeros(len(a)), np.ones(len(a))
            for k in range(4):
                c, d = window[:, k], window[:, (k + 1) % 4]
                fa, fb = _cross(d - c, a - c), _cross(d - c, b - c)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = fa / (fa - fb)
                start = np.where(fb > fa, np.maximum(start, t), start)
                stop = np.where(fb < fa, np.minimum(stop, t), stop)
                along = ((b - a) * (d - c)).sum(axis=1) > 0
                out = (fa == fb) & ((fa < 0) | ((fa == 0) & (second | ~along)))
                stop = np.where(out, -1.0, stop)
            used = stop > start
            first, last = a + start[:, None] * (b - a), a + stop[:, None] * (b - a)
            total += np.where(used, _cross(first, last) / 2, 0.0)
    return np.maximum(total, 0.0)


QUAD = [f"{axis}{i}" for i in range(1, 5) for axis in ("x", "y")]


@F.pandas_udf(T.DoubleType())
def quad_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """IoU of two convex quads given as arrays of eight numbers."""
    p, q = (np.stack(s.to_numpy()).astype(float).reshape(-1, 4, 2) for s in (a, b))
    shared = _shared_area(p, q)
    union = np.abs(_quad_area(p)) + np.abs(_quad_area(q)) - shared
    return pd.Series(np.divide(shared, union, out=np.zeros_like(union), where=union != 0))


def quad_iou_pairs(quads: DataFrame, above: float = 0.0) -> DataFrame:
    """IoU of convex quads: grid pairs of their bounding boxes, then clipping."""
    low = lambda axis: F.least(*[f"{axis}{i}" for i in range(1, 5)])
    high = lambda axis: F.greatest(*[f"{axis}{i}" for i in range(1, 5)])
    framed = quads.select(
        *IMAGE, "box_id", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"), F.array(*QUAD).alias("quad"))
    both = _met(framed, 0.0, ("quad",))
    return both.select(*IMAGE, "box_a", "box_b", quad_iou("quad_a", "quad_b").alias("iou")).filter(F.col("iou") > above)


def _sides_of(boxes: DataFrame) -> list[str]:
    """Coordinate columns: those of quads where the table has them."""
    return QUAD if set(QUAD) <= set(boxes.columns) else SIDES


def _overlaps(boxes: DataFrame) -> DataFrame:
    """``(image_id, box_a, box_b, iou)`` of the boxes that overlap."""
    if _sides_of(boxes) is QUAD:
        return quad_iou_pairs(boxes, TOUCHING)
    return iou_pairs(boxes).select(*IMAGE, "box_a", "box_b", "iou")


def _both_ways(overlaps: DataFrame) -> DataFrame:
    turned = overlaps.select(*IMAGE, F.col("box_b").alias("box_id"), F.col("box_a").alias("other"), "iou")
    return turned.unionByName(overlaps.select(*IMAGE, F.col("box_a").alias("box_id"), F.col("box_b").alias("other"), "iou"))


def _table(boxes: DataFrame) -> DataFrame:
    return boxes.select(*IMAGE, "box_id", *[F.col(c).cast("double").alias(c) for c in (*_sides_of(boxes), "score")])


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Images to walk through in one task each, and the rest, if any.

    The rest are crowded images and those with values that numpy would treat
    otherwise than Spark: nulls, NaN, infinite or negative numbers as scores.
    """
    odd = F.lit(False)
    for name in (*_sides_of(rows), "score"):
        odd = odd | ~F.coalesce(is_finite(F.col(name)), F.lit(False))
    odd = odd | F.col("image_id").isNull() | F.col("box_id").isNull() | (F.col("score") < 0)
    apart = rows.groupBy(F.col("image_id").alias("_image")).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(odd).alias("_odd")).filter(
        (F.col("_n") > CROWD) | F.col("_odd")).select("_image").checkpoint()
    if apart.isEmpty():
        return rows, None
    same = F.col("image_id").eqNullSafe(F.col("_image"))
    return rows.join(apart, same, "left_anti"), rows.join(apart, same, "left_semi").checkpoint()


def _iou_of(group: Columns, sides: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping pairs of one image, as places in the group, and their IoU; as ``_overlaps`` finds them."""
    corners = np.column_stack([group[c] for c in sides])
    if len(sides) == len(QUAD):
        x, y = corners[:, ::2], corners[:, 1::2]
        frame = np.column_stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)])
    else:
        frame = corners
    width = np.minimum(frame[:, None, 2], frame[:, 2]) - np.maximum(frame[:, None, 0], frame[:, 0])
    height = np.minimum(frame[:, None, 3], frame[:, 3]) - np.maximum(frame[:, None, 1], frame[:, 1])
    # The box with the smaller id comes first.
    a, b = np.nonzero((width > 0) & (height > 0) & (group["box_id"][:, None] < group["box_id"]))
    if len(sides) == len(QUAD):
        p, q = corners[a].reshape(-1, 4, 2), corners[b].reshape(-1, 4, 2)
        shared = _shared_area(p, q)
        union, least = np.abs(_quad_area(p)) + np.abs(_quad_area(q)) - shared, TOUCHING
    else:
        size = (frame[:, 2] - frame[:, 0]) * (frame[:, 3] - frame[:, 1])
        shared = width[a, b] * height[a, b]
        union, least = size[a] + size[b] - shared, 0.0
    found = np.divide(shared, union, out=np.zeros_like(union), where=union != 0)
    near = found > least
    return a[near], b[near], found[near]


def _schema_of(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def nms(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Keep the highest score, drop boxes overlapping it above the threshold, repeat.

    Equal scores rank by id, the smaller first. An image of up to ``CROWD``
    boxes is walked through in that order, the others go by rounds.
    """
    shared_folder(boxes.sparkSession)
    few, crowded = _split(_table(boxes))
    sides = _sides_of(boxes)

    def walk(group: Columns) -> Columns:
        a, b, near = _iou_of(group, sides)
        a, b = a[near > threshold], b[near > threshold]
        close = np.zeros((len(group["box_id"]),) * 2, dtype=bool)
        close[a, b] = close[b, a] = True
        stays = np.ones(len(close), dtype=bool)
        for i in np.unique(np.minimum(a, b)):
            if stays[i]:
                stays[i + 1:] &= ~close[i, i + 1:]
        return {name: values[stays] for name, values in group.items()}

    kept = fold_groups(few, IMAGE, [F.desc("score"), F.asc("box_id")], walk, _schema_of(few))
    return kept if crowded is None else kept.unionByName(_nms_rounds(crowded, threshold))


def _nms_rounds(rows: DataFrame, threshold: float) -> DataFrame:
    """Suppression in images of any size.

    An overlap above the threshold is an edge from the box that ranks first
    (higher score, then smaller id) to the other. A round keeps every box that
    no edge leads to, drops what its edges lead to and goes on with the edges
    between the rest. Boxes without edges stay untouched.
    """
    ranked = rows.select(*IMAGE, "box_id", F.struct("score", (-F.col("box_id")).alias("minus_id")).alias("rank"))
    close = _overlaps(rows).filter(F.col("iou") > threshold)
    a, b = (ranked.select(*IMAGE, F.col("box_id").alias(f"box_{p}"), F.col("rank").alias(f"rank_{p}")) for p in "ab")
    both = close.join(a, [*IMAGE, "box_a"]).join(b, [*IMAGE, "box_b"])
    ahead = F.col("rank_a") > F.col("rank_b")
    edges = both.select(*IMAGE, F.when(ahead, F.col("box_a")).otherwise(F.col("box_b")).alias("first"),
                        F.when(ahead, F.col("box_b")).otherwise(F.col("box_a")).alias("second")).checkpoint()
    lost = edges.select(*IMAGE, F.col("second").alias("box_id")).limit(0)
    while not edges.isEmpty():
        met = edges.select(*IMAGE, F.col("second").alias("first")).distinct()
        tops = edges.join(met, [*IMAGE, "first"], "left_anti")
        gone = tops.select(*IMAGE, F.col("second").alias("box_id")).distinct().checkpoint()
        lost = lost.unionByName(gone)
        edges = edges.join(gone.withColumnRenamed("box_id", "first"), [*IMAGE, "first"], "left_anti").join(
            gone.withColumnRenamed("box_id", "second"), [*IMAGE, "second"], "left_anti").checkpoint()
    return rows.join(lost, [*IMAGE, "box_id"], "left_anti").select(rows.columns)


def soft_nms(
    boxes: DataFrame, method: str = "gaussian", overlap_limit: float = 0.3, floor: float = 0.8, sigma: float = 0.5
) -> DataFrame:
    """Score decay instead of dropping: ``linear``, ``gaussian`` or ``hard``; weak boxes go.

    An image of up to ``CROWD`` boxes is walked through from the best box left
    to the worst, the others go by rounds.
    """
    shared_folder(boxes.sparkSession)
    few, crowded = _split(_table(boxes))
    sides = _sides_of(boxes)

    def walk(group: Columns) -> Columns:
        a, b, near = _iou_of(group, sides)
        if method == "gaussian":
            pulled = np.exp(-near * near / sigma)
        elif method == "linear":
            pulled = np.where(near > overlap_limit, 1 - near, 1.0)
        else:
            pulled = np.where(near > overlap_limit, 0.0, 1.0)
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        others, pulls = np.concatenate([b, a])[order], np.concatenate([pulled, pulled])[order]
        now = group["score"].astype(float)
        starts = np.searchsorted(np.concatenate([a, b])[order], np.arange(len(now) + 1))
        left, final = now.copy(), np.full(len(now), -np.inf)
        # Rows come by id, so the first of the highest scores is the one with the smallest id.
        while (best := int(left.argmax())) >= 0 and left[best] > -np.inf:
            final[best], left[best] = left[best], -np.inf
            met = slice(starts[best], starts[best + 1])
            weaker = left[others[met]] * pulls[met]
            left[others[met]] = np.where(weaker >= floor, weaker, -np.inf)
        stays = final > -np.inf
        return {name: values[stays] for name, values in (group | {"score": final}).items()}

    made = fold_groups(few, IMAGE, ["box_id"], walk, _schema_of(few))
    return made if crowded is None else made.unionByName(_soft_rounds(crowded, method, overlap_limit, floor, sigma))


def _soft_rounds(rows: DataFrame, method: str, overlap_limit: float, floor: float, sigma: float) -> DataFrame:
    """Score decay in images of any size.

    A round makes every box final whose score no box that it overlaps exceeds:
    scores only fall, so nothing left can outrank it. Final boxes weaken their
    neighbours. A box keeps its own score and the weights it met, and applies
    them in the order of the final boxes' ranks, as a walk one by one would.
    """
    near = _both_ways(_overlaps(rows)).checkpoint()
    shared = F.col("iou")
    if method == "gaussian":
        weight = F.exp(-shared * shared / sigma)
    elif method == "linear":
        weight = F.when(shared > overlap_limit, 1 - shared).otherwise(1.0)
    else:
        weight = F.when(shared > overlap_limit, 0.0).otherwise(1.0)
    met = F.array().cast("array<struct<minus_score:double,other:bigint,weight:double>>")
    open_rows = rows.select(*IMAGE, "box_id", "score", F.col("score").alias("now"), met.alias("met")).checkpoint()
    final = open_rows.select(*IMAGE, "box_id", F.col("now").alias("score")).limit(0)
    while not open_rows.isEmpty():
        rank = F.struct(F.col("now"), (-F.col("box_id")).alias("minus_id"))
        others = open_rows.select(*IMAGE, F.col("box_id").alias("other"), rank.alias("_rank"))
        best = near.join(others, [*IMAGE, "other"]).groupBy(*IMAGE, "box_id").agg(F.max("_rank").alias("_best"))
        judged = open_rows.join(best, [*IMAGE, "box_id"], "left").withColumn("_wins", F.coalesce(rank > F.col("_best"), F.lit(True))).checkpoint()
        winners = judged.filter("_wins").select(*IMAGE, F.col("box_id").alias("other"), F.col("now").alias("_won"))
        final = final.unionByName(judged.filter("_wins").select(*IMAGE, "box_id", F.col("now").alias("score")))
        blows = near.join(winners, [*IMAGE, "other"]).groupBy(*IMAGE, "box_id").agg(
            F.collect_list(F.struct((-F.col("_won")).alias("minus_score"), "other", weight.alias("weight"))).alias("_new"))
        weaker = judged.filter("NOT _wins").join(blows, [*IMAGE, "box_id"], "left").withColumn(
            "met", F.when(F.col("_new").isNull(), F.col("met")).otherwise(F.array_sort(F.concat("met", F.col("_new")))))
        now = F.aggregate("met", F.col("score"), lambda s, m: m["weight"] * s)
        open_rows = weaker.withColumn("now", now).filter(F.col("_new").isNull() | (F.col("now") >= floor)).select(open_rows.columns).checkpoint()
    return rows.drop("score").join(final, [*IMAGE, "box_id"]).select(rows.columns)


def _quads_of(group: Columns, sides: list[str]) -> np.ndarray:
    """Corners as rows of eight numbers."""
    names = sides if sides is QUAD else ["x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"]
    return np.column_stack([group[c].astype(float) for c in names])


def _merge_walk(group: Columns, sides: list[str], threshold: float):
    """Merges consecutive overlapping boxes by score, from the box that the group's state holds open.

    Returns the boxes closed on the way and the one left open, each as ten
    numbers: corners, score and the id of the first box in it.
    """
    last = np.array([group[k][0] for k in HELD], dtype=float) if group["held"][0] else None
    rows = np.column_stack([_quads_of(group, sides), group["score"].astype(float), group["box_id"]])
    hits, plain, closed = _merging(rows[:-1], rows[1:], threshold), False, []
    for i, row in enumerate(rows):
        if last is not None:
            # Neighbours that came unmerged were compared all at once.
            if hits[i - 1] if plain else _merging(last[None], row[None], threshold)[0]:
                total = row[8] + last[8]
                last, plain = np.array([*((row[8] * row[:8] + last[8] * last[:8]) / total), total, last[9]]), False
                continue
            closed.append(last)
        last, plain = row, True
    return closed, last


def _merging(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the quads in the first eight columns overlap above the threshold, row by row."""
    x, y, u, v = right[:, :8:2], right[:, 1:8:2], left[:, :8:2], left[:, 1:8:2]
    meet = (x.min(1) < u.max(1)) & (u.min(1) < x.max(1)) & (y.min(1) < v.max(1)) & (v.min(1) < y.max(1))
    if meet.any():
        p, q = right[meet, :8].reshape(-1, 4, 2), left[meet, :8].reshape(-1, 4, 2)
        shared = _shared_area(p, q)
        union = np.abs(_quad_area(p)) + np.abs(_quad_area(q)) - shared
        meet[meet] = np.divide(shared, union, out=np.zeros_like(union), where=union != 0) > threshold
    return meet


HELD = [f"held_{i}" for i in range(10)]


def locality_merge(boxes: DataFrame, threshold: float = 0.3, spans: Spans | None = None) -> DataFrame:
    """Merge runs of consecutive overlapping boxes by score, then suppress.

    Boxes go by id, block by block; a block that starts inside a merge is
    walked again from the box left open. Scores must not sum to zero.
    """
    shared_folder(boxes.sparkSession)
    spans = ensure_spans(boxes, IMAGE, "box_id", spans)
    sides = _sides_of(boxes)
    rows = in_blocks(_table(boxes), IMAGE, ["box_id"], spans)

    def leave(group: Columns) -> Columns:
        _, last = _merge_walk(group, sides, threshold)
        return {"held": np.array([True]), **{k: np.array([v]) for k, v in zip(HELD, last)}}

    def close(group: Columns) -> Columns | None:
        closed, last = _merge_walk(group, sides, threshold)
        if group["last"][0]:
            closed.append(last)
        if not closed:
            return None
        table = np.array(closed)
        columns = QUAD if sides is QUAD else ["x0", "y0", None, None, "x1", "y1", None, None]
        return {"image_id": group["image_id"][0], "box_id": table[:, 9].astype("int64"),
                **{c: table[:, i] for i, c in enumerate(columns) if c}, "score": table[:, 8]}

    state = {"held": ("boolean", False), **{k: ("double", 0.0) for k in HELD}}
    out = "image_id long, box_id long, " + ", ".join(f"{c} double" for c in (*sides, "score"))
    return nms(fold_in_blocks(rows, IMAGE, ["box_id"], leave, close, state, out).checkpoint(), threshold)


def drop_low_score(results: DataFrame, limit: float = 0.5) -> DataFrame:
    return results.filter(F.col("score") >= limit)


def reading_order(boxes: DataFrame, row: float = 10.0, spans: Spans | None = None) -> DataFrame:
    """Top-down, left-right order with one pass that swaps neighbours of a text row.

    ``boxes(image_id, box_id, x, y)``. The pass carries one box along. Its y
    never exceeds its sorted neighbour's, so a step of ``row`` or more in y ends
    every swap and a block that begins there needs nothing from before.
    """
    spans = ensure_spans(boxes, IMAGE, "y", spans)
    order = ["y", "x", "box_id"]
    rows = boxes.select(*IMAGE, "box_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = with_position(rows, IMAGE, order, spans, "sorted").withColumn("block", F.floor((F.col("sorted") - 1) / blocks.BLOCK))

    def walk(group: Columns):
        """Boxes in the order they are placed, and the one carried out."""
        carry = (group["held_id"][0], group["held_x"][0], group["held_y"][0]) if group["held"][0] else None
        out = []
        for box in zip(group["box_id"], group["x"], group["y"]):
            if carry is None:
                carry = box
            elif abs(box[2] - carry[2]) < row and box[1] < carry[1]:
                out.append(box[0])
            else:
                out.append(carry[0])
                carry = box
        return out, carry

    def leave(group: Columns) -> Columns:
        _, carry = walk(group)
        return {"held": np.array([True]), **{f"held_{n}": np.array([v]) for n, v in zip(("id", "x", "y"), carry)}}

    def close(group: Columns) -> Columns | None:
        out, carry = walk(group)
        if group["last"][0]:
            out.append(carry[0])
        if not out:
            return None
        first = group["sorted"][0] - int(group["held"][0])
        return {"image_id": group["image_id"][0], "box_id": np.array(out), "place": first + np.arange(len(out))}

    state = {"held": ("boolean", False), "held_id": ("bigint", 0), "held_x": ("double", 0.0), "held_y": ("double", 0.0)}
    return fold_in_blocks(placed, IMAGE, ["sorted"], leave, close, state, "image_id long, box_id long, place long")


def order_quad(quads: DataFrame) -> DataFrame:
    """Corners as top-left, top-right, bottom-right, bottom-left.

    The two smallest x are the left pair; each pair is ordered by y. Sorting a
    four-element array in place needs no shuffle.
    """
    corner = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.lit(i).alias("i"), F.col(f"y{i}").alias("y"))
    by_x = F.array_sort(F.array(*[corner(i) for i in range(1, 5)]))
    by_y = lambda part: F.array_sort(F.transform(part, lambda c: F.struct(c["y"].alias("y"), c["i"].alias("i"), c["x"].alias("x"))))
    rest = [c for c in quads.columns if c not in QUAD]
    pairs = quads.select(*rest, by_x.alias("_c")).select(
        *rest, by_y(F.slice("_c", 1, 2)).alias("_l"), by_y(F.slice("_c", 3, 2)).alias("_r")
    )
    corners = [F.col("_l")[0], F.col("_r")[0], F.col("_r")[1], F.col("_l")[1]]
    return pairs.select(*rest, *[c[axis].alias(f"{axis}{i}") for i, c in enumerate(corners, 1) for axis in ("x", "y")])


def clip_and_filter_boxes(quads: DataFrame, width: int, height: int, min_side: int = 3) -> DataFrame:
    """Ordered corners clipped into the image and truncated; thin boxes are dropped."""
    rest = [c for c in quads.columns if c not in QUAD]
    inside = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(size - 1))).cast("long").cast("double").alias(c)
    cut = order_quad(quads).select(*rest, *[inside(f"{axis}{i}", width if axis == "x" else height) for i in range(1, 5) for axis in ("x", "y")])
    side = lambda a, b: F.floor(F.hypot(F.col(f"x{a}") - F.col(f"x{b}"), F.col(f"y{a}") - F.col(f"y{b}")))
    return cut.filter((side(1, 2) > min_side) & (side(1, 4) > min_side))


