"""Validation reports and scores of outlines and rectangular designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.numeric import EPS, is_finite
from sweepfield.operators import contours
from sweepfield.operators.contours import KEY
from sweepfield.plans.grid import around
from sweepfield.plans.ordered import Spans, ensure_spans, with_group, with_neighbours

# Limits of the loop report.
CLOSURE_TOL = 1e-6
CLOSURE_REPAIR_TOL = 0.01
PLANARITY_TOL = 1e-9
MIN_EDGE = 0.01
AREA_EPS = 1e-12
DUPLICATE_TOL = 1e-9


def _messages(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(text)) for hit, text in rules]))


def validate_loops(
    points: DataFrame, loops: DataFrame, broken: DataFrame | None = None, spans: Spans | None = None
) -> DataFrame:
    """Report of every loop: measures plus error and warning lists.

    ``points(contour_id, idx, x, y, z)``; ``loops(contour_id, design_id,
    closed)`` gives the expected flag; ``broken(contour_id, …)`` has one row per
    broken segment. Loops under three points get only that error.
    """
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = with_group(
        contours.linked(points, spans, cyclic=True, fields=["idx", "x", "y", "z"]),
        KEY, {"_n": F.count(F.lit(1)), "_z0": F.min_by("z", "idx")}, spans,
    )
    edge = F.hypot(F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"))
    step = F.sqrt(
        F.pow(F.col("next.x") - F.col("x"), 2.0) + F.pow(F.col("next.y") - F.col("y"), 2.0) + F.pow(F.col("next.z") - F.col("z"), 2.0)
    )
    inner = ~F.col("is_last")
    measured = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.max(F.when(~inner, edge)).alias("gap"),
        F.max(F.abs(F.col("z") - F.col("_z0"))).alias("max_z_deviation"),
        F.min(F.when(inner, edge)).alias("_open_edge"),
        F.max(F.when(~inner & (F.col("_n") >= 3) & (edge > 1e-12), edge)).alias("_closing_edge"),
        F.abs(contours.shoelace()).alias("area"),
        F.count_if(inner & (step <= DUPLICATE_TOL)).alias("duplicates"),
    )
    crossed = contours.self_intersections(points, "proper", spans)
    rep = loops.join(measured, KEY).join(crossed, KEY, "left")
    if broken is not None:
        rep = rep.join(broken.groupBy(*KEY).agg(F.count(F.lit(1)).alias("broken_segments")), KEY, "left")
    else:
        rep = rep.withColumn("broken_segments", F.lit(0).cast("long"))
    c = F.col
    shortest = F.when(c("closed"), F.least("_open_edge", "_closing_edge")).otherwise(c("_open_edge"))
    rep = rep.select(
        "design_id", *KEY, "point_count", c("closed").alias("closed_expected"), "gap", (c("gap") < CLOSURE_TOL).alias("is_closed"),
        "max_z_deviation", (c("max_z_deviation") < PLANARITY_TOL).alias("planar"), (c("crossings") > 0).alias("self_intersection"),
        F.coalesce(shortest, F.lit(0.0)).alias("min_edge"), "area", "duplicates",
        F.coalesce("broken_segments", F.lit(0)).cast("long").alias("broken_segments"),
    )
    enough = c("point_count") >= 3
    errors = _messages(
        (~enough, "less than 3 points"),
        (enough & c("closed_expected") & ~c("is_closed"), "open loop"),
        (enough & ~c("closed_expected"), "not marked closed"),
        (enough & ~c("planar"), "non-planar"),
        (enough & (c("min_edge") < MIN_EDGE), "minimum edge too short"),
        (enough & (c("area") <= AREA_EPS), "zero or tiny area"),
        (enough & c("self_intersection"), "self intersection"),
    )
    duplicate = F.when(enough & (c("duplicates") > 0), 1).otherwise(0)
    warning_count = F.when(enough, c("broken_segments")).otherwise(0) + duplicate
    return rep.select("*", errors.alias("errors"), warning_count.cast("long").alias("warning_count"))


def robustness_score(report: DataFrame) -> DataFrame:
    """Score of each design from its loop reports, within 0..1; 0 without a usable loop."""
    c = F.col
    gap_cost = F.when(c("gap") > CLOSURE_TOL, F.least(F.lit(0.2), c("gap") / max(CLOSURE_REPAIR_TOL, 1e-12) * 0.1)).otherwise(0.0)
    cost = (
        gap_cost + F.when(c("min_edge") < MIN_EDGE, 0.1).otherwise(0.0)
        + F.when(c("self_intersection"), 0.4).otherwise(0.0) + F.when(~c("planar"), 0.2).otherwise(0.0)
    )
    usable = c("point_count") >= 3
    sums = report.groupBy("design_id").agg(
        F.sum(F.size("errors")).cast("long").alias("error_count"), F.sum("warning_count").alias("warning_count"),
        F.count_if(usable).alias("_loops"), F.sum(F.when(usable, cost).otherwise(0.0)).alias("_cost"),
    )
    score = 1.0 - F.least(F.lit(0.7), 0.15 * c("error_count")) - F.least(F.lit(0.2), 0.03 * c("warning_count")) - c("_cost")
    return sums.select(
        "design_id", "error_count", "warning_count", (c("error_count") == 0).alias("valid"),
        F.when(c("_loops") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"),
    )


def constraint_score(
    base: Column, max_turn: Column, minimum_gap: Column, errors: Column, turn_limit: float = 160.0, gap_limit: float = 0.01
) -> Column:
    """Base score less turn, gap and error penalties; the two limits add errors of their own."""
    sharp, narrow = max_turn > turn_limit, F.coalesce(minimum_gap < gap_limit, F.lit(False))
    count = errors + sharp.cast("int") + narrow.cast("int")
    score = (
        base - F.when(sharp, F.least(F.lit(0.25), (max_turn - turn_limit) / 180.0)).otherwise(0.0)
        - F.when(narrow, 0.20).otherwise(0.0) - F.least(F.lit(0.5), count * 0.12)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def complexity_metrics(primitive_points: DataFrame, tiny: float = 0.20, spans: Spans | None = None) -> DataFrame:
    """Component, primitive, spline and tiny-segment counts and the splines' curvature sum.

    ``primitive_points(design_id, comp, primitive_id, type, idx, x, y)``. Any
    kind that names a spline or is neither line nor arc counts as a spline.
    """
    key = ["design_id", "comp", "primitive_id"]
    spans = ensure_spans(primitive_points, key, "idx", spans)
    rows = with_neighbours(primitive_points, key, ["idx"], ["x", "y"], spans)
    kind = F.lower(F.coalesce("type", F.lit("")))
    spline = kind.contains("spline") | ~kind.isin("line", "arc")
    ax, ay = F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")
    bend = F.abs(contours.heading_change())
    per = rows.groupBy(*key).agg(
        F.bool_or(spline).alias("_spline"),
        F.coalesce(F.sum(F.when(spline, bend)), F.lit(0.0)).alias("_bend"),
        F.count_if(F.coalesce(F.hypot(ax, ay) < tiny, F.lit(False))).alias("_tiny"),
    )
    return per.groupBy("design_id").agg(
        F.count_distinct("comp").alias("component_count"), F.count(F.lit(1)).alias("primitive_count"),
        F.count_if("_spline").alias("spline_count"), F.sum("_bend").alias("curvature_sum"),
        F.sum("_tiny").alias("tiny_count"),
    )


def edge_of_point(x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column, tol: float = 1e-7) -> Column:
    """Name of the rectangle edge that holds a point, or null."""
    across = x.between(left - tol, right + tol)
    along = y.between(bottom - tol, top + tol)
    return (
        F.when((F.abs(y - bottom) <= tol) & across, "bottom").when((F.abs(y - top) <= tol) & across, "top")
        .when((F.abs(x - left) <= tol) & along, "left").when((F.abs(x - right) <= tol) & along, "right")
    )


def validate_rect_design(patch: DataFrame, slots: DataFrame, feed: DataFrame, tol: float = 1e-7) -> DataFrame:
    """Error list of each rectangular design: patch, slots and feed rules.

    ``patch(design_id, width, length, cx, cy, material)``; ``slots(design_id,
    slot_id, shape, x, y, width, height)``; ``feed(design_id, x, y, width,
    direction)``.
    """
    c = F.col
    good = lambda v: F.coalesce(is_finite(v) & (v > 0), F.lit(False))
    boxed = patch.select(
        "*", (c("cx") - c("width") / 2).alias("left"), (c("cx") + c("width") / 2).alias("right"),
        (c("cy") - c("length") / 2).alias("bottom"), (c("cy") + c("length") / 2).alias("top"),
    )
    sides = boxed.select("design_id", "left", "right", "bottom", "top")
    known = c("shape").isin("rectangle", "circle")
    tall = F.when(c("shape") == "circle", c("width")).otherwise(c("height"))
    placed = slots.join(sides, "design_id").select(
        "design_id", "slot_id", known.alias("known"),
        (good(c("width")) & ((c("shape") != "rectangle") | good(c("height")))).alias("sized"),
        ((c("x") - c("width") / 2 > c("left") + tol) & (c("x") + c("width") / 2 < c("right") - tol)
         & (c("y") - tall / 2 > c("bottom") + tol) & (c("y") + tall / 2 < c("top") - tol)).alias("inside"),
    )
    ids = placed.groupBy("design_id", "slot_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~c("known")).alias("_unknown"),
        F.count_if(c("known") & ~c("sized")).alias("_unsized"), F.count_if(c("known") & ~c("inside")).alias("_outside"),
    )
    slot_sums = ids.groupBy("design_id").agg(
        F.sum(c("_n") - 1).alias("duplicate_slots"), F.sum("_unknown").alias("unknown_slots"),
        F.sum("_unsized").alias("unsized_slots"), F.sum("_outside").alias("outside_slots"),
    )
    fed = feed.select("design_id", c("x").alias("fx"), c("y").alias("fy"), c("width").alias("fw"), "direction")
    edge = edge_of_point(c("fx"), c("fy"), c("left"), c("bottom"), c("right"), c("top"), tol)
    rows = boxed.join(fed, "design_id", "left").join(slot_sums, "design_id", "left").select("*", edge.alias("edge"))
    half = c("fw") / 2
    outside = F.when(
        c("edge").isin("top", "bottom"), (c("fx") - half < c("left") - tol) | (c("fx") + half > c("right") + tol)
    ).otherwise((c("fy") - half < c("bottom") - tol) | (c("fy") + half > c("top") + tol))
    fits = good(c("fw"))
    some = lambda name: F.coalesce(c(name) > 0, F.lit(False))
    errors = _messages(
        (~good(c("length")), "patch length"), (~good(c("width")), "patch width"),
        (F.upper("material") != "PEC", "patch material"),
        (some("duplicate_slots"), "duplicate slot id"), (some("unknown_slots"), "slot shape"),
        (some("unsized_slots"), "slot size"), (some("outside_slots"), "slot outside patch"),
        (~fits, "feed width"), (fits & c("edge").isNull(), "feed off edge"),
        (fits & (c("edge") != c("direction")), "feed direction"),
        (fits & c("edge").isNotNull() & outside, "feed span"),
    )
    return rows.select("design_id", errors.alias("errors")).select("*", (F.size("errors") == 0).alias("valid"))


def shape_quality(
    before: DataFrame, after: DataFrame, max_curvature: float = 0.30, max_energy: float = 0.18,
    continuous: Column | None = None, spans: Spans | None = None,
) -> DataFrame:
    """Curvature change and deformation energy of each outline against its former self."""
    spans = ensure_spans(before, KEY, "idx", spans)
    moved = after.select(*KEY, "idx", F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = before.join(moved, [*KEY, "idx"]).select(*KEY, "idx", "x", "y", "x2", "y2")
    rows = with_neighbours(both, KEY, ["idx"], ["x", "y", "x2", "y2"], spans)
    inner = F.col("prev").isNotNull() & F.col("next").isNotNull()

    def bend(x: str, y: str) -> Column:
        ax, ay = F.col(x) - F.col(f"prev.{x}"), F.col(y) - F.col(f"prev.{y}")
        bx, by = F.col(f"next.{x}") - F.col(x), F.col(f"next.{y}") - F.col(y)
        la, lb = F.hypot(ax, ay), F.hypot(bx, by)
        angle = F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
        return F.when((la <= 1e-12) | (lb <= 1e-12), 0.0).otherwise(angle / F.greatest(0.5 * (la + lb), F.lit(EPS)))

    def second(a: str, b: str) -> Column:
        d = lambda p: F.col(f"{p}{b}") - F.col(f"{p}{a}")
        return d("prev.") - 2.0 * d("") + d("next.")

    ddx, ddy = second("x", "x2"), second("y", "y2")
    step = F.hypot(F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"))
    sums = rows.groupBy(*KEY).agg(
        F.max(F.when(inner, F.abs(bend("x2", "y2") - bend("x", "y")))).alias("curvature_delta"),
        F.sum(F.when(inner, ddx * ddx + ddy * ddy)).alias("energy"),
        F.sum(step).alias("_length"),
    )
    scale = F.greatest("_length", F.lit(EPS))
    ratio = F.coalesce(F.col("energy") / (scale * scale), F.lit(0.0))
    delta = F.coalesce("curvature_delta", F.lit(0.0))
    smooth = F.lit(1.0) if continuous is None else F.when(continuous, 1.0).otherwise(0.0)
    score = (
        0.45 * F.greatest(F.lit(0.0), 1.0 - delta / max(max_curvature, EPS))
        + 0.35 * F.greatest(F.lit(0.0), 1.0 - ratio / max(max_energy, EPS)) + 0.20 * smooth
    )
    return sums.select(
        *KEY, delta.alias("curvature_delta"), ratio.alias("energy_ratio"), score.alias("score"),
        ((delta <= max_curvature) & (ratio <= max_energy)).alias("valid"),
    )


def tangent_continuity(endpoints: DataFrame, reach: float = 1.0, max_angle: float = 70.0) -> DataFrame:
    """Spline ends whose tangent breaks against another primitive's end within ``reach``.

    ``endpoints(design_id, primitive_id, endpoint, type, x, y, tx, ty)`` with
    unit tangents. Ends meet through grid cells of the reach's size.
    """
    cell = lambda v: F.floor(F.col(v) / reach).cast("long")
    placed = endpoints.filter(F.col("tx").isNotNull()).select("*", cell("x").alias("cell_x"), cell("y").alias("cell_y"))
    names = ["primitive_id", "endpoint", "x", "y", "tx", "ty"]
    other = around(placed.select("design_id", *[F.col(n).alias(f"o_{n}") for n in names], "cell_x", "cell_y")).drop("_home")
    pairs = placed.filter(F.upper("type") == "BSPLINE").join(other, ["design_id", "cell_x", "cell_y"])
    near = pairs.filter(
        (F.col("primitive_id") != F.col("o_primitive_id"))
        & (F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")) <= reach)
    )
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("tx") * F.col("o_tx") + F.col("ty") * F.col("o_ty")))
    return near.select(
        "design_id", "primitive_id", "endpoint", "o_primitive_id", "o_endpoint", F.degrees(F.acos(F.abs(dot))).alias("angle")
    ).filter(F.col("angle") > max_angle)
