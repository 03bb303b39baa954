"""Measures of outlines: ``points(contour_id, idx, x, y[, z])`` with ``idx`` dense from 0."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.numeric import EPS, clip, rounded
from sweepfield.plans.grid import SMALL, around
from sweepfield.plans.ordered import Spans, ensure_spans, with_group, with_neighbours
from sweepfield.plans.sizing import broadcast_if_small
from sweepfield.session import shared_folder

KEY = ["contour_id"]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def linked(points: DataFrame, spans: Spans | None, cyclic: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Points with their neighbours; ``is_first`` and ``is_last`` mark the ends."""
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = with_neighbours(points, KEY, ["idx"], fields or ["idx", "x", "y"], spans, cyclic=cyclic)
    if cyclic:
        first, last = F.col("prev.idx") >= F.col("idx"), F.col("next.idx") <= F.col("idx")
    else:
        first, last = F.col("prev").isNull(), F.col("next").isNull()
    return rows.select("*", first.alias("is_first"), last.alias("is_last"))


def _to_next() -> Column:
    return distance(F.col("x"), F.col("y"), F.col("next.x"), F.col("next.y"))


def _to_prev() -> Column:
    return distance(F.col("prev.x"), F.col("prev.y"), F.col("x"), F.col("y"))


def bbox(points: DataFrame) -> DataFrame:
    return points.groupBy(*KEY).agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")
    )


def normalized_box(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Box columns from two corners in any order."""
    return [
        F.least(x1, x2).alias("min_x"), F.least(y1, y2).alias("min_y"),
        F.greatest(x1, x2).alias("max_x"), F.greatest(y1, y2).alias("max_y"),
    ]


def shoelace() -> Column:
    return F.sum(F.col("x") * F.col("next.y") - F.col("next.x") * F.col("y")) / 2


def signed_area(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Shoelace area with wrap-around, counter-clockwise positive; 0 under 3 points."""
    area = F.when(F.count(F.lit(1)) < 3, F.lit(0.0)).otherwise(shoelace())
    return linked(points, spans, cyclic=True).groupBy(*KEY).agg(area.alias("signed_area"))


def polyline_length(points: DataFrame, closed: bool = False, spans: Spans | None = None) -> DataFrame:
    rows = linked(points, spans, cyclic=closed)
    return rows.groupBy(*KEY).agg(F.coalesce(F.sum(_to_next()), F.lit(0.0)).alias("length"))


def edge_stats(points: DataFrame, min_edge: float, closed: bool = True, spans: Spans | None = None) -> DataFrame:
    """Tiny-edge count and shortest edge.

    The closing edge counts as tiny only beyond a gap of 1e-9 and joins the
    minimum only beyond 1e-12 and from three points on.
    """
    rows = with_group(linked(points, spans, cyclic=True), KEY, {"_n": F.count(F.lit(1))}, ensure_spans(points, KEY, "idx", spans))
    size, inner = _to_next(), ~F.col("is_last")
    tiny = (inner | (F.lit(closed) & (size > 1e-9))) & (size < min_edge)
    usable = inner | (F.lit(closed) & (F.col("_n") >= 3) & (size > 1e-12))
    return rows.groupBy(*KEY).agg(
        F.count_if(tiny & (F.col("_n") >= 2)).alias("tiny_count"),
        F.coalesce(F.min(F.when(usable, size)), F.lit(0.0)).alias("min_edge"),
    )


def min_feature_and_gaps(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Smallest non-zero edge of the closed loop; largest and mean gap of the open one."""
    rows = linked(points, spans, cyclic=True)
    size, inner = _to_next(), ~F.col("is_last")
    found = rows.groupBy(*KEY).agg(
        F.coalesce(F.min(F.when(size > 1e-10, size)), F.lit(0.0)).alias("min_feature"),
        F.max(F.when(inner, size)).alias("max_gap"), F.avg(F.when(inner, size)).alias("mean_gap"),
    )
    return found.select("*", F.coalesce(F.col("max_gap") < 10, F.lit(False)).alias("connected"))


def duplicate_points(points: DataFrame, tol: float = 1e-6, spans: Spans | None = None) -> DataFrame:
    """Points within ``tol`` of the point before."""
    rows = linked(points, spans)
    return rows.groupBy(*KEY).agg(F.count_if(F.coalesce(_to_prev() <= tol, F.lit(False))).alias("duplicates"))


def drop_duplicates_lag(points: DataFrame, tol: float = 1e-6, spans: Spans | None = None) -> DataFrame:
    """Drop each point closer than ``tol`` to its immediate predecessor."""
    rows = linked(points, spans)
    return rows.filter(F.col("is_first") | (_to_prev() >= tol)).select(*points.columns)


def grid_duplicates(points: DataFrame, tol: float = 1e-7, spans: Spans | None = None) -> DataFrame:
    """Later points that share a rounded grid cell with an earlier one."""
    scale = 1.0 / tol
    keyed = points.select(*KEY, "idx", F.rint(F.col("x") * scale).alias("gx"), F.rint(F.col("y") * scale).alias("gy"))
    firsts = with_group(keyed, [*KEY, "gx", "gy"], {"first_index": F.min("idx")}, ensure_spans(points, KEY, "idx", spans))
    return firsts.filter(F.col("idx") > F.col("first_index")).select(*KEY, "first_index", F.col("idx").alias("duplicate_index"))


# ---- crossings -------------------------------------------------------------

VARIANTS = {
    # name: (tolerance, collinear touches count)
    "touch": (1e-9, True),
    "proper": (0.0, False),
    "loop": (1e-7, True),
    "gate": (0.0, True),
    # Strict crossings of the evaluation report: closed rings and open lines.
    "ring": (0.0, False),
    "open": (0.0, False),
}
STRICT = 1e-12


def outline_edges(points: DataFrame, variant: str, spans: Spans) -> DataFrame:
    """Edges of each outline with its edge count and extent; closing edge by variant."""
    rows = linked(points, spans, cyclic=True)
    gap = _to_next()
    keep = {
        "touch": ~F.col("is_last") | (gap > 1e-9),
        "proper": ~F.col("is_last") | (F.col("x") != F.col("next.x")) | (F.col("y") != F.col("next.y")),
        "loop": F.lit(True),
        "ring": F.lit(True),
        "open": ~F.col("is_last"),
        "gate": ~F.col("is_last"),
    }[variant]
    edges = rows.filter(keep).select(
        *KEY, "idx", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("next.x").alias("x2"), F.col("next.y").alias("y2")
    )
    return with_group(edges, KEY, {
        "edge_count": F.count(F.lit(1)), "last": F.max("idx"),
        "lo_x": F.min(F.least("x1", "x2")), "hi_x": F.max(F.greatest("x1", "x2")),
        "lo_y": F.min(F.least("y1", "y2")), "hi_y": F.max(F.greatest("y1", "y2")),
    }, spans)


def _turn(p: str, q: str, r: str) -> Column:
    px, py, qx, qy, rx, ry = (F.col(f"{n}{axis}") for n in (p, q, r) for axis in ("x", "y"))
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def near_edges(edges: DataFrame, tol: float, spans: Spans) -> DataFrame:
    """Pairs of edges of an outline whose frames, widened by the tolerance, touch, met in the cells of a grid of levels.

    ``i`` < ``j`` number the edges, ``a``-``b`` and ``c``-``d`` are their ends
    in either order, ``ab_`` and ``cd_`` their frames; ``last`` is the outline's
    last edge.
    """
    ends, box = ["x1", "y1", "x2", "y2"], ["left", "right", "low", "high"]
    extent = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"))
    # Coordinates are made non-null once; an edge without a place meets nothing.
    solid = edges.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ends}).filter(~F.isnan(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")))
    framed = solid.withColumns({
        "left": F.least("x1", "x2") - tol, "right": F.greatest("x1", "x2") + tol, "low": F.least("y1", "y2") - tol, "high": F.greatest("y1", "y2") + tol,
        "one_cell": F.col("edge_count") <= SMALL,
    })
    length = F.greatest(F.col("right") - F.col("left"), F.col("high") - F.col("low"), extent * 1e-12, F.lit(1e-300))
    sized = framed.withColumn("own", F.when(F.col("one_cell"), F.lit(0).cast("long")).otherwise(F.ceil(F.log2(length))))
    levelled = with_group(sized, KEY, {"top": F.max("own")}, spans)
    at = lambda place: F.when(F.col("one_cell"), F.lit(0).cast("long")).otherwise(F.floor(place / F.pow(F.lit(2.0), F.col("level"))))
    across = lambda low, high: F.explode(F.sequence(at(F.col(low)), at(F.col(high))))
    edge = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("idx", "own", *ends, *box)]
    grid = [*KEY, "level", "cell_x", "cell_y"]

    def covered(rows: DataFrame) -> DataFrame:
        return rows.select("*", across("left", "right").alias("cell_x")).select("*", across("low", "high").alias("cell_y"))

    looking = covered(levelled.withColumn("level", F.explode(F.sequence("own", "top")))).select(*grid, *edge("s_"))
    standing = covered(levelled.withColumn("level", F.col("own"))).select(*grid, *edge("t_"), "last", "one_cell")
    home = lambda side, cell: F.col("one_cell") | (at(F.greatest(f"s_{side}", f"t_{side}")) == F.col(cell))
    once = F.when(F.col("s_own") < F.col("t_own"), F.col("s_idx") != F.col("t_idx")).otherwise(F.col("s_idx") < F.col("t_idx"))
    # Frames that lie apart cannot meet.
    touch = reduce(and_, [F.col(f"{p}_{low}") <= F.col(f"{q}_{high}") for p, q in ("st", "ts") for low, high in (("left", "right"), ("low", "high"))])
    met = looking.join(standing, grid).filter(once & touch & home("left", "cell_x") & home("low", "cell_y"))
    side = lambda p, a, b, frame: [
        F.col(f"{p}_x1").alias(f"{a}x"), F.col(f"{p}_y1").alias(f"{a}y"), F.col(f"{p}_x2").alias(f"{b}x"), F.col(f"{p}_y2").alias(f"{b}y"),
        *[F.col(f"{p}_{n}").alias(f"{frame}_{n}") for n in box],
    ]
    return met.select(
        *KEY, F.least("s_idx", "t_idx").alias("i"), F.greatest("s_idx", "t_idx").alias("j"), *side("s", "a", "b", "ab"), *side("t", "c", "d", "cd"), "last")


def crossing_pairs(points: DataFrame, variant: str = "touch", spans: Spans | None = None) -> DataFrame:
    """Pairs of crossing edges of each outline.

    Edges meet on a grid of levels. An edge stands in the cells of the level of
    its own size and looks at the cells that it covers on each level above up
    to the longest edge's, so one far vertex crowds nothing. A pair counts in the
    cell of the lower corner that its frames share, so no pair appears twice.
    Outlines of few edges are one cell.
    """
    spans = ensure_spans(points, KEY, "idx", spans)
    tol, touching = VARIANTS[variant]
    pairs = near_edges(outline_edges(points, variant, spans), tol, spans)
    if variant in ("gate", "open"):
        pairs = pairs.filter(F.col("j") > F.col("i") + (1 if variant == "open" else 0))
    else:
        pairs = pairs.filter((F.col("j") > F.col("i") + 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("last"))))
    pairs = pairs.select(
        "*", _turn("a", "b", "c").alias("o1"), _turn("a", "b", "d").alias("o2"),
        _turn("c", "d", "a").alias("o3"), _turn("c", "d", "b").alias("o4"),
    )
    o1, o2, o3, o4 = (F.col(o) for o in ("o1", "o2", "o3", "o4"))

    def within(frame: str, q: str) -> Column:
        x, y = F.col(f"{q}x"), F.col(f"{q}y")
        return (x >= F.col(f"{frame}_left")) & (x <= F.col(f"{frame}_right")) & (y >= F.col(f"{frame}_low")) & (y <= F.col(f"{frame}_high"))

    limit = -tol if variant == "loop" else 0.0
    # How the pair meets: 1 for a proper crossing, 2..5 for an end on the other edge.
    crossing = (o1 * o2 < limit) & (o3 * o4 < limit)
    if variant in ("ring", "open"):
        crossing = crossing & (F.least(*[F.abs(o) for o in (o1, o2, o3, o4)]) > STRICT)
    how = F.when(crossing, 1)
    ends = [(o1, "ab", "c"), (o2, "ab", "d"), (o3, "cd", "a"), (o4, "cd", "b")]
    if touching:
        for code, (turn, frame, q) in enumerate(ends, 2):
            how = how.when((F.abs(turn) <= tol) & within(frame, q), code)
    met = pairs.withColumn("how", how).filter(F.col("how").isNotNull())
    return met.select(*KEY, F.col("i").alias("edge_a"), F.col("j").alias("edge_b"))


def self_intersections(points: DataFrame, variant: str = "touch", spans: Spans | None = None) -> DataFrame:
    """Number of crossing non-adjacent edge pairs of every outline."""
    found = crossing_pairs(points, variant, spans).groupBy(*KEY).agg(F.count(F.lit(1)).alias("crossings"))
    every = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    count = F.when(F.col("_n") < 4, F.lit(0)).otherwise(F.coalesce("crossings", F.lit(0))).cast("long")
    return every.join(found, KEY, "left").select(*KEY, count.alias("crossings"))


def crossing_count_equals_edges(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """True when crossing pairs, adjacent ones included, are as many as the segments."""
    found = crossing_pairs(points, "gate", spans).groupBy(*KEY).agg(F.count(F.lit(1)).alias("pairs"))
    every = points.groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("segments"))
    pairs = F.coalesce("pairs", F.lit(0)).cast("long")
    return every.join(found, KEY, "left").select(*KEY, pairs.alias("pairs"), "segments", (pairs == F.col("segments")).alias("passes"))


def minimum_gap(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Smallest distance between points that are not neighbours; null under 4 points.

    ``points`` may hold several components per outline in ``comp``. The
    distance of every second point along the outline bounds the answer, and
    cells of that size leave only real candidates for the join.
    """
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = points if "comp" in points.columns else points.withColumn("comp", F.lit(0).cast("long"))
    rows = with_group(rows, [*KEY, "comp"], {"comp_last": F.max("idx")}, spans)
    order = ["idx", "comp"] if spans else ["comp", "idx"]
    fields = ["comp", "idx", "x", "y"]
    near = with_neighbours(rows, KEY, order, fields, spans, prev=None, next="one")
    near = with_neighbours(near, KEY, order, ["one"], spans, prev=None, next="two")
    two = F.col("two.one")
    apart = (F.col("comp") != two["comp"]) | ((F.abs(F.col("idx") - two["idx"]) > 1) & ~((F.least(F.col("idx"), two["idx"]) == 0) & (F.greatest(F.col("idx"), two["idx"]) == F.col("comp_last"))))
    bound = F.min(F.when(apart, distance(F.col("x"), F.col("y"), two["x"], two["y"])))
    sizes = near.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), bound.alias("_bound"), F.min("x").alias("lo_x"), F.min("y").alias("lo_y")
    )
    # A few points need no bound; one cell holds them all.
    reach = F.when(F.col("_bound") > 0, F.col("_bound") * (1 + 1e-9)).otherwise(F.lit(1e-9))
    cut = lambda v, lo: F.floor((F.col(v) - F.col(lo)) / F.col("_reach")).cast("long")
    placed = rows.join(sizes.filter(F.col("_n") >= 4).select(*KEY, "lo_x", "lo_y", reach.alias("_reach")), KEY).select(
        *KEY, "comp", "idx", "x", "y", "comp_last", cut("x", "lo_x").alias("cell_x"), cut("y", "lo_y").alias("cell_y")
    )
    other = around(placed, half=True).select(
        *KEY, "cell_x", "cell_y", "_home", *[F.col(c).alias(f"o_{c}") for c in ("comp", "idx", "x", "y")]
    )
    pairs = placed.join(other, [*KEY, "cell_x", "cell_y"])
    ordered = (F.col("comp") < F.col("o_comp")) | ((F.col("comp") == F.col("o_comp")) & (F.col("idx") < F.col("o_idx")))
    same = F.col("comp") == F.col("o_comp")
    low, high = F.least("idx", "o_idx"), F.greatest("idx", "o_idx")
    neighbour = same & ((high - low <= 1) | ((low == 0) & (high == F.col("comp_last"))))
    gaps = pairs.filter((~F.col("_home") | ordered) & ~neighbour).groupBy(*KEY).agg(
        F.min(distance(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y"))).alias("minimum_gap")
    )
    return sizes.select(*KEY).join(gaps, KEY, "left")


# ---- angles and curvature --------------------------------------------------


def _vectors() -> tuple[Column, Column, Column, Column]:
    return (
        F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y"),
        F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"),
    )


def turn_degrees() -> Column:
    """Angle between the edges into and out of a point; 180 for a zero-length edge."""
    ax, ay, bx, by = _vectors()
    la, lb = F.hypot(ax, ay), F.hypot(bx, by)
    cosine = clip(F.try_divide(ax * bx + ay * by, la * lb), -1.0, 1.0)
    return F.when((la <= 1e-12) | (lb <= 1e-12), F.lit(180.0)).otherwise(F.degrees(F.acos(cosine)))


def point_curvature() -> Column:
    """Turn over mean edge length; 0 on a zero-length edge."""
    ax, ay, bx, by = _vectors()
    la, lb = F.hypot(ax, ay), F.hypot(bx, by)
    angle = F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    return F.when((la <= 1e-12) | (lb <= 1e-12), F.lit(0.0)).otherwise(angle / F.greatest(0.5 * (la + lb), F.lit(EPS)))


def heading_change() -> Column:
    """Signed change of direction wrapped into [-pi, pi)."""
    ax, ay, bx, by = _vectors()
    two_pi = 2 * math.pi
    delta = F.atan2(by, bx) - F.atan2(ay, ax)
    return F.pmod(delta + F.lit(math.pi), F.lit(two_pi)) - F.lit(math.pi)


def inner_points(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Points with both neighbours."""
    return linked(points, spans).filter(~F.col("is_first") & ~F.col("is_last"))


def turning_angles(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    return inner_points(points, spans).select(*KEY, "idx", turn_degrees().alias("turn"))


def max_turn(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    rows = linked(points, spans)
    inner = ~F.col("is_first") & ~F.col("is_last")
    return rows.groupBy(*KEY).agg(F.coalesce(F.max(F.when(inner, turn_degrees())), F.lit(0.0)).alias("max_turn"))


def curvature_profile(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    return inner_points(points, spans).select(*KEY, "idx", point_curvature().alias("curvature"))


def curvature_proxy(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Sum of absolute heading changes."""
    rows = linked(points, spans)
    inner = ~F.col("is_first") & ~F.col("is_last")
    return rows.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(inner, F.abs(heading_change()))), F.lit(0.0)).alias("curvature_proxy")
    )


def heading_variance_score(points: DataFrame, max_variance: float = 0.5, spans: Spans | None = None) -> DataFrame:
    """Variance of the heading change as a score in (0, 1]; 0 under 3 points."""
    rows = linked(points, spans)
    inner = ~F.col("is_first") & ~F.col("is_last")
    found = rows.groupBy(*KEY).agg(F.var_pop(F.when(inner, heading_change())).alias("heading_variance"))
    score = F.coalesce(1.0 / (1.0 + F.col("heading_variance") / (max_variance + 1e-9)), F.lit(0.0))
    return found.select("*", score.alias("stability_score"))


def curvature_continuity(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """How little the cyclic curvature changes from point to point, in (0, 1]."""
    spans = ensure_spans(points, KEY, "idx", spans)
    ax, ay, bx, by = _vectors()
    la, lb = F.hypot(ax, ay), F.hypot(bx, by)
    bend = F.abs(ax * by - ay * bx) / (la * la * la + 1e-10)
    # The corner at the first point closes the loop, so it comes last.
    place = F.when(F.col("is_first"), F.col("prev.idx") + 1).otherwise(F.col("idx"))
    bends = linked(points, spans, cyclic=True).filter((la > 1e-10) & (lb > 1e-10)).select(
        *KEY, place.alias("place"), bend.alias("bend")
    )
    steps = with_neighbours(bends, KEY, ["place"], ["bend"], spans, next=None)
    means = steps.groupBy(*KEY).agg(F.avg(F.abs(F.col("bend") - F.col("prev.bend"))).alias("_step"))
    every = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    value = F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(F.coalesce(1.0 / (1.0 + F.col("_step")), F.lit(0.0)))
    return every.join(means, KEY, "left").select(*KEY, value.alias("continuity"))


def right_angle_ratio(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Share of cyclic corners within 5 degrees of a right angle."""
    ax, ay, bx, by = _vectors()
    la, lb = F.hypot(ax, ay), F.hypot(bx, by)
    usable = (la > 1e-10) & (lb > 1e-10)
    turn = F.degrees(F.acos(clip(F.try_divide(ax * bx + ay * by, la * lb), -1.0, 1.0)))
    square = (F.abs(turn - 90) < 5) | (F.abs(turn - 270) < 5)
    found = linked(points, spans, cyclic=True).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(usable).alias("_all"), F.count_if(usable & square).alias("_square")
    )
    ratio = F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(F.col("_square") / F.greatest(F.col("_all"), F.lit(1)))
    return found.select(*KEY, ratio.alias("right_angle_ratio"))


# ---- planarity, closure, placement -----------------------------------------


def planarity(points: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Largest distance of z from the first point's z, from two extremes."""
    found = points.groupBy(*KEY).agg(
        F.min_by("z", "idx").alias("_z"), F.min("z").alias("_low"), F.max("z").alias("_high")
    )
    deviation = F.greatest(F.col("_high") - F.col("_z"), F.col("_z") - F.col("_low"))
    return found.select(*KEY, deviation.alias("max_deviation"), (deviation < tol).alias("planar"))


def closure_gap(points: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Distance between first and last point; closed when below ``tol``."""
    spot = F.struct("x", "y")
    ends = points.groupBy(*KEY).agg(F.min_by(spot, "idx").alias("a"), F.max_by(spot, "idx").alias("b"))
    gap = distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    return ends.select(*KEY, gap.alias("gap"), (gap < tol).alias("closed"))


def segment_connectivity(segments: DataFrame, tol: float = 1e-6, spans: Spans | None = None) -> DataFrame:
    """Segments whose end misses the next start: ``segments(contour_id, idx, x1, y1, x2, y2)``."""
    spans = ensure_spans(segments, KEY, "idx", spans)
    rows = with_neighbours(segments, KEY, ["idx"], ["x1", "y1"], spans, prev=None)
    gap = distance(F.col("x2"), F.col("y2"), F.col("next.x1"), F.col("next.y1"))
    return rows.select(*KEY, F.col("idx").alias("segment_index"), gap.alias("gap")).filter(F.col("gap") > tol)


def outside_ratio(points: DataFrame, canvas: DataFrame) -> DataFrame:
    """Share of points beyond the canvas plus 5 %; 0 without a canvas."""
    sized = points.join(broadcast_if_small(canvas.select(*KEY, "width", "height")), KEY, "left")
    w, h = F.col("width"), F.col("height")
    beyond = (
        (F.col("x") < -0.05 * w) | (F.col("x") > w + 0.05 * w) | (F.col("y") < -0.05 * h) | (F.col("y") > h + 0.05 * h)
    )
    known = (w > 0) & (h > 0)
    share = F.avg(F.when(known & beyond, 1.0).otherwise(0.0))
    return sized.groupBy(*KEY).agg(share.alias("outside_ratio"))


def edge_clearance(
    primitive_points: DataFrame,
    canvas: DataFrame,
    min_clearance: float = 10.0,
    ratio: float = 0.02,
) -> DataFrame:
    """Clearance of each primitive to the board edge and whether it is too small.

    ``primitive_points(design_id, primitive_id, role, in_corridor, x, y)``:
    ports and feed lines touching the port corridor are exempt.
    """
    key = ["design_id"]
    sized = primitive_points.join(broadcast_if_small(canvas.select(*key, "width", "height")), key)
    sized = sized.filter((F.col("width") > 0) & (F.col("height") > 0))
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    found = sized.groupBy(*key, "primitive_id", "role", "width", "height").agg(
        F.min(F.least(x, w - x, y, h - y)).alias("clearance"), F.bool_or("in_corridor").alias("_corridor")
    )
    required = F.greatest(F.lit(float(min_clearance)), ratio * F.least(w, h))
    exempt = (F.col("role") == "PORT") | ((F.col("role") == "FEEDLINE") & F.col("_corridor"))
    return found.select(
        *key, "primitive_id", "clearance", required.alias("required"), exempt.alias("exempt"),
        (~exempt & (F.col("clearance") < required)).alias("violation"),
    )


def topology_signature(components: DataFrame) -> DataFrame:
    """Counts per design from ``components(design_id, comp, closed, nodes, edges)``."""
    return components.groupBy("design_id").agg(
        F.count(F.lit(1)).alias("component_count"), F.count_if("closed").alias("closed_count"),
        F.sum("nodes").alias("node_count"), F.sum("edges").alias("edge_count"),
    )


def topology_diff(components: DataFrame, reference: DataFrame) -> DataFrame:
    """Component changes are errors, node and edge changes warnings.

    Closed flags are compared component by component through a join.
    """
    side = lambda df, p: df.select("design_id", "comp", *[F.col(c).alias(f"{p}_{c}") for c in ("closed", "nodes", "edges")])
    both = side(components, "a").join(side(reference, "b"), ["design_id", "comp"], "full")
    sums = both.groupBy("design_id").agg(
        F.count("a_closed").alias("_na"), F.count("b_closed").alias("_nb"),
        F.count_if(~F.col("a_closed").eqNullSafe(F.col("b_closed"))).alias("_flags"),
        *[F.coalesce(F.sum(f"{p}_{c}"), F.lit(0)).alias(f"_{p}_{c}") for p in "ab" for c in ("nodes", "edges")],
    )
    return sums.select(
        "design_id",
        (F.col("_na") != F.col("_nb")).alias("component_count_changed"),
        (F.col("_flags") > 0).alias("closed_flags_changed"),
        (F.col("_a_nodes") != F.col("_b_nodes")).alias("node_count_changed"),
        (F.col("_a_edges") != F.col("_b_edges")).alias("edge_count_changed"),
    )


# ---- reshaping -------------------------------------------------------------


def resample_every(points: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th point, closed again.

    A loop whose length divides by the step gets its first point appended;
    otherwise the last kept point moves onto the first.
    """
    ends = points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("x", "y"), "idx").alias("_first")
    )
    kept = points.filter(F.col("idx") % step == 0).join(ends, KEY)
    place = F.floor(F.col("idx") / step).cast("long")
    last = F.floor((F.col("_n") - 1) / step).cast("long")
    whole = F.col("_n") % step == 0
    moved = ~whole & (place == last)
    rows = kept.select(
        *KEY, place.alias("idx"), F.when(moved, F.col("_first.x")).otherwise(F.col("x")).alias("x"),
        F.when(moved, F.col("_first.y")).otherwise(F.col("y")).alias("y"),
    )
    closing = ends.filter(whole).select(*KEY, (last + 1).alias("idx"), F.col("_first.x").alias("x"), F.col("_first.y").alias("y"))
    return rows.unionByName(closing)


def densify(points: DataFrame, min_points: int, spans: Spans | None = None) -> DataFrame:
    """Fill outlines below ``min_points``: two points evenly, more by repeated midpoints, then cut.

    After k halvings each edge holds 2**k steps, so every new point is one
    linear expression of its edge.
    """
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = with_group(linked(points, spans), KEY, {"_n": F.count(F.lit(1))}, spans)
    n = F.col("_n")
    halvings = F.greatest(F.lit(1), F.ceil(F.log2(F.try_divide(F.lit(min_points) - 1, n - 1))))
    enough = (n >= min_points) | (n < 2)
    steps = F.when(enough, F.lit(1)).when(n == 2, F.lit(min_points - 1)).otherwise(F.pow(F.lit(2.0), halvings)).cast("long")
    count = F.when(F.col("is_last"), F.lit(0).cast("long")).otherwise(steps - 1)
    spread = rows.select("*", steps.alias("_steps"), F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("_k"))
    t = F.col("_k") / F.col("_steps")
    place = F.col("idx") * F.col("_steps") + F.col("_k")
    blend = lambda a: F.when(F.col("_k") == 0, F.col(a)).otherwise(F.col(a) + t * (F.col(f"next.{a}") - F.col(a)))
    return spread.filter(enough | (place < min_points)).select(*KEY, place.alias("idx"), blend("x").alias("x"), blend("y").alias("y"))


def filter_contours(
    points: DataFrame, min_area: float = 10.0, min_perimeter: float = 10.0, min_points: int = 3, spans: Spans | None = None
) -> DataFrame:
    """Outlines large enough by area, closed perimeter and point count."""
    found = linked(points, spans, cyclic=True).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("point_count"), F.abs(shoelace()).alias("area"), F.sum(_to_next()).alias("perimeter")
    )
    return found.filter(
        (F.col("point_count") >= min_points) & (F.col("area") >= min_area) & (F.col("perimeter") >= min_perimeter)
    )


def mirror_symmetry(points: DataFrame) -> DataFrame:
    """``xy``, ``x``, ``y`` or ``none``: whether each vertex's mirror image exists.

    An anti-join on rounded vertices; the join key is the vertex, not the outline.
    """
    boxed = points.join(bbox(points), KEY)
    key = lambda v: rounded(v)
    here = points.select(*KEY, key(F.col("x")).alias("kx"), key(F.col("y")).alias("ky")).distinct()
    mid_x, mid_y = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    mirrored = boxed.select(*KEY, F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), key(F.col("x")).alias("kx"), key(2 * mid_y - F.col("y")).alias("ky")),
        F.struct(F.lit("y").alias("axis"), key(2 * mid_x - F.col("x")).alias("kx"), key(F.col("y")).alias("ky")),
    )))
    missing = mirrored.join(here, [*KEY, "kx", "ky"], "left_anti").groupBy(*KEY).agg(
        F.bool_or(F.col("axis") == "x").alias("_x"), F.bool_or(F.col("axis") == "y").alias("_y")
    )
    no_x, no_y = F.coalesce("_x", F.lit(False)), F.coalesce("_y", F.lit(False))
    kind = F.when(~no_x & ~no_y, "xy").when(~no_x, "x").when(~no_y, "y").otherwise("none")
    return bbox(points).select(*KEY).join(missing, KEY, "left").select(*KEY, kind.alias("symmetry"))


def is_rectangle(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Whether the loop is its own bounding box, and whether it holds all four corners."""
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = with_group(points, KEY, {
        "_lo_x": F.min("x"), "_hi_x": F.max("x"), "_lo_y": F.min("y"), "_hi_y": F.max("y"),
    }, spans)
    same = lambda a, b: rounded(F.col(a), 9) == rounded(F.col(b), 9)
    corners = [("_lo_x", "_lo_y"), ("_hi_x", "_lo_y"), ("_hi_x", "_hi_y"), ("_lo_x", "_hi_y")]
    code = F.lit(0)
    for bit, (cx, cy) in enumerate(corners):
        code = code + F.when(same("x", cx) & same("y", cy), F.lit(1 << bit)).otherwise(F.lit(0))
    found = rows.withColumn("_code", code).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_or("_code").alias("_seen"), F.min("_code").alias("_least")
    )
    full = F.col("_seen") == 15
    return found.select(*KEY, ((F.col("_n") == 4) & full & (F.col("_least") > 0)).alias("rectangle"), full.alias("has_corners"))


def contour_depth_tree(hierarchy: DataFrame) -> DataFrame:
    """Nearest odd-numbered ancestor of every odd contour, from ``hierarchy(id, parent)``.

    Even contours are skipped by pointer doubling, so the rounds grow with the
    logarithm of the depth. Each round is checkpointed to the shared folder. A
    contour that only leads round a cycle of even parents has no ancestor: as
    many doublings as the number of even contours has binary digits reach every
    end there is.
    """
    shared_folder(hierarchy.sparkSession)
    jump = hierarchy.select("id", F.col("parent").alias("up"))
    even = jump.filter(F.col("id") % 2 == 0).checkpoint()
    open_ends = (F.col("up") >= 0) & (F.col("up") % 2 == 0)
    for _ in range(even.count().bit_length()):
        even = even.checkpoint()
        if even.filter(open_ends).isEmpty():
            break
        hop = even.select(F.col("id").alias("up"), F.col("up").alias("_further"))
        even = even.join(hop, "up", "left").select(
            "id", F.when(open_ends, F.coalesce("_further", F.lit(-1))).otherwise(F.col("up")).alias("up")
        )
    hop = even.select(F.col("id").alias("up"), F.when(~open_ends, F.col("up")).alias("_further"))
    odd = jump.filter(F.col("id") % 2 != 0).join(hop, "up", "left")
    target = F.when((F.col("up") >= 0) & (F.col("up") % 2 == 0), F.col("_further")).otherwise(F.col("up"))
    return odd.select("id", F.when(target >= 0, target).alias("ancestor"))


def pixel_scale(perimeter: Column, size_x: Column, size_y: Column) -> Column:
    """Length units per pixel from the outer outline's whole-pixel perimeter."""
    return F.try_divide(2 * (size_x + size_y), F.floor(perimeter))


def curve_geometry_score(features: DataFrame) -> DataFrame:
    """Score of fit, curvature, length and prior rules, at most 1.

    Reads ``fits, fit_quality, stability_score, length, area, closed, outer,
    image_perimeter, image_area``.
    """
    c = F.col
    # The weights of the four rules.
    fit = F.when(c("fits"), 0.4 * c("fit_quality")).otherwise(0.1 * (1.0 - c("fit_quality")))
    length = F.least(F.lit(1.0), F.try_divide("length", "image_perimeter") * 10.0)
    size = F.when(
        c("area") > 0, 0.3 * F.least(F.lit(1.0), F.log1p(F.try_divide("area", "image_area") * 100) / math.log1p(10))
    ).otherwise(F.lit(0.05))
    prior = F.least(
        F.lit(1.0), F.when(c("closed"), 0.4).otherwise(0.1) + F.when(c("outer"), 0.3).otherwise(0.1) + size
    )
    score = fit + 0.15 * c("stability_score") + 0.2 * length + 0.25 * prior
    return features.select("*", F.least(F.lit(1.0), score).alias("score"))


def orient_ccw(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Reverse the vertex order of loops with negative area."""
    area = signed_area(points, spans)
    sizes = points.groupBy(*KEY).agg(F.max("idx").alias("_last"))
    rows = points.join(area.join(sizes, KEY), KEY)
    place = F.when(F.col("signed_area") < 0, F.col("_last") - F.col("idx")).otherwise(F.col("idx"))
    rest = [c for c in points.columns if c not in (*KEY, "idx")]
    return rows.select(*KEY, place.alias("idx"), *rest)


