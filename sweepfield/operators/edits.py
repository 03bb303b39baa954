"""Geometry edits as joins of a point or design table with a table of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.numeric import stable_unit
from sweepfield.operators import contours
from sweepfield.plans.ordered import Spans, ensure_spans, measure_spans, with_group, with_position
from sweepfield.plans.sizing import broadcast_if_small

KEY = ["contour_id"]
DESIGN = ["design_id"]


def affine(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply one edit per outline.

    ``edits(contour_id, op, dx, dy, angle, factor, cx, cy)`` with op translate,
    rotate, scale, mirror_x or mirror_y. Outlines without an edit stay put.
    """
    c = F.col
    names = ["op", "dx", "dy", "angle", "factor", "cx", "cy"]
    rows = points.join(broadcast_if_small(edits.select(*KEY, *names)), KEY, "left")
    rx, ry, turn = c("x") - c("cx"), c("y") - c("cy"), F.radians("angle")
    x = (
        F.when(c("op") == "translate", c("x") + c("dx")).when(c("op") == "rotate", c("cx") + rx * F.cos(turn) - ry * F.sin(turn))
        .when(c("op") == "scale", c("cx") + rx * c("factor")).when(c("op") == "mirror_y", 2 * c("cx") - c("x")).otherwise(c("x"))
    )
    y = (
        F.when(c("op") == "translate", c("y") + c("dy")).when(c("op") == "rotate", c("cy") + rx * F.sin(turn) + ry * F.cos(turn))
        .when(c("op") == "scale", c("cy") + ry * c("factor")).when(c("op") == "mirror_x", 2 * c("cy") - c("y")).otherwise(c("y"))
    )
    rest = [n for n in points.columns if n not in ("x", "y", "width")]
    width = [F.when(c("op") == "scale", c("width") * F.abs("factor")).otherwise(c("width")).alias("width")] if "width" in points.columns else []
    return rows.select(*rest, x.alias("x"), y.alias("y"), *width)


def resize_patch(patches: DataFrame, feeds: DataFrame, edits: DataFrame) -> DataFrame:
    """New patch sizes about the fixed centre, with the feed back on its edge.

    ``patches(design_id, width, length, cx, cy)``; ``feeds(design_id, x, y,
    width, length, direction)``; ``edits(design_id, width, length)`` nullable.
    The feed's far end stays where it was, so its length follows the edge.
    """
    c = F.col
    wanted = edits.select(*DESIGN, c("width").alias("new_width"), c("length").alias("new_length"))
    fed = feeds.select(*DESIGN, c("x").alias("fx"), c("y").alias("fy"), c("width").alias("fw"), c("length").alias("fl"), "direction")
    sized = patches.join(wanted, DESIGN, "left").join(fed, DESIGN, "left").select(
        *DESIGN, "cx", "cy", F.coalesce("new_width", "width").alias("width"), F.coalesce("new_length", "length").alias("length"),
        "fx", "fy", "fw", "fl", "direction",
    )
    left, right = c("cx") - c("width") / 2, c("cx") + c("width") / 2
    bottom, top = c("cy") - c("length") / 2, c("cy") + c("length") / 2
    half = c("fw") / 2
    level = c("direction").isin("top", "bottom")
    inside = lambda v, lo, hi: F.least(F.greatest(v, lo + half), hi - half)
    x = F.when(level, inside(c("fx"), left, right)).when(c("direction") == "left", left).when(c("direction") == "right", right)
    y = F.when(c("direction") == "bottom", bottom).when(c("direction") == "top", top).otherwise(inside(c("fy"), bottom, top))
    terminal = (
        F.when(c("direction") == "bottom", y - (c("fy") - c("fl"))).when(c("direction") == "top", c("fy") + c("fl") - y)
        .when(c("direction") == "left", x - (c("fx") - c("fl"))).when(c("direction") == "right", c("fx") + c("fl") - x)
    )
    return sized.select(
        *DESIGN, "cx", "cy", "width", "length", x.alias("feed_x"), y.alias("feed_y"), c("fw").alias("feed_width"),
        F.greatest(F.lit(0.0), terminal).alias("feed_length"), "direction",
    )


def edit_slots(slots: DataFrame, deletions: DataFrame, additions: DataFrame) -> DataFrame:
    """Slot table after deletions by id and additions."""
    kept = slots.join(deletions.select(*DESIGN, "slot_id"), [*DESIGN, "slot_id"], "left_anti")
    return kept.unionByName(additions.select(*slots.columns))


def apply_offsets(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """Move control points by offsets clamped into their ranges.

    ``points(…, point_id, x, y, dx_low, dx_high, dy_low, dy_high)``;
    ``offsets(contour_id, point_id, dx, dy)``. A missing offset is 0 before clamping.
    """
    c = F.col
    key = [*KEY, "point_id"]
    rows = points.join(offsets.select(*key, "dx", "dy"), key, "left")
    clamp = lambda v, low, high: F.greatest(c(low), F.least(F.coalesce(c(v), F.lit(0.0)), c(high)))
    dx, dy = clamp("dx", "dx_low", "dx_high"), clamp("dy", "dy_low", "dy_high")
    moved = (F.abs("_dx") > 1e-15) | (F.abs("_dy") > 1e-15)
    rest = [n for n in points.columns if n not in ("x", "y")]
    return rows.withColumn("_dx", dx).withColumn("_dy", dy).select(
        *rest, F.when(moved, c("x") + c("_dx")).otherwise(c("x")).alias("x"), F.when(moved, c("y") + c("_dy")).otherwise(c("y")).alias("y"),
        F.when(moved, c("_dx")).alias("moved_x"), F.when(moved, c("_dy")).alias("moved_y"),
    )


def displacement_stats(moved: DataFrame) -> DataFrame:
    """Displacement summary per outline from ``apply_offsets`` rows with a ``point_class``."""
    size = F.hypot("moved_x", "moved_y")
    held = lambda v: F.coalesce(v, F.lit(0.0))
    return moved.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("selected_points"), held(F.avg(size)).alias("mean_displacement"),
        held(F.max(size)).alias("max_displacement"), held(F.min(size)).alias("min_displacement"),
        *[F.count_if(F.col("point_class") == name).alias(f"{name.lower()}_points") for name in ("RESONANT", "FEEDLINE", "STRUCTURAL")],
        F.count("moved_x").alias("moved_points"),
    )


def gaussian_deform(points: DataFrame, moves: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Move a centre point and its neighbourhood with weight ``exp(-d²/σ²)``.

    ``moves(contour_id, center_index, dx, dy)`` one per outline; a null centre
    means the middle internal point. σ is twice the mean spacing, ends are
    frozen and the points next to them move by 0.55 of their share.
    """
    c = F.col
    spans = ensure_spans(points, KEY, "idx", spans)
    step = F.hypot(c("next.x") - c("x"), c("next.y") - c("y"))
    sizes = contours.linked(points, spans).groupBy(*KEY).agg(F.max("idx").alias("_last"), F.avg(step).alias("_step"))
    inner = c("_last") - 3
    default = F.when(inner > 0, 2 + F.floor(inner / 2)).otherwise(F.floor((c("_last") + 1) / 2)).cast("long")
    wanted = moves.join(sizes, KEY).select(
        *KEY, "dx", "dy", "_last", F.greatest(F.coalesce(F.greatest(c("_step") * 2.0, F.lit(1e-6)), F.lit(1.0)), F.lit(1e-9)).alias("_sigma"),
        F.greatest(F.lit(0).cast("long"), F.least("_last", F.coalesce(c("center_index").cast("long"), default))).alias("_centre"),
    )
    here = points.select(*KEY, c("idx").alias("_centre"), c("x").alias("_cx"), c("y").alias("_cy"))
    centred = wanted.join(here, [*KEY, "_centre"])
    rows = points.join(broadcast_if_small(centred), KEY)
    far = (c("x") - c("_cx")) * (c("x") - c("_cx")) + (c("y") - c("_cy")) * (c("y") - c("_cy"))
    frozen = (c("_last") >= 1) & ((c("idx") == 0) | (c("idx") == c("_last")))
    handle = (c("idx") == 1) | (c("idx") == c("_last") - 1)
    weight = F.when(frozen, 0.0).otherwise(F.exp(-far / (c("_sigma") * c("_sigma"))) * F.when(handle, 0.55).otherwise(1.0))
    return rows.withColumn("weight", weight).select(
        *KEY, "idx", (c("x") + c("weight") * c("dx")).alias("x"), (c("y") + c("weight") * c("dy")).alias("y"), "weight"
    )


def slot_value_mapping(slots: DataFrame, values: DataFrame) -> DataFrame:
    """Internal moves and size changes of each slot from sampled values.

    ``slots(design_id, slot_id, min_x…max_y, parent_min_x…parent_max_y, length,
    width, length_axis)``; ``values(design_id, slot_id, scale_x, scale_y, cx,
    cy, length, width, dx, dy)`` with null for a missing value. A slot without
    a parent box moves as sampled, with nothing to hold it in.
    """
    c = F.col
    given = values.select(*DESIGN, "slot_id", "scale_x", "scale_y", "cx", "cy", *[c(n).alias(f"v_{n}") for n in ("length", "width", "dx", "dy")])
    rows = slots.join(given, [*DESIGN, "slot_id"])

    def scaled(prefix: str, axis: str) -> tuple[Column, Column]:
        a = c(f"c{axis}") + (c(f"{prefix}min_{axis}") - c(f"c{axis}")) * c(f"scale_{axis}")
        b = c(f"c{axis}") + (c(f"{prefix}max_{axis}") - c(f"c{axis}")) * c(f"scale_{axis}")
        return F.least(a, b), F.greatest(a, b)

    def clamped(value: Column, centre: Column, size: Column, low: Column, high: Column) -> Column:
        half = 0.5 * F.greatest(F.lit(1e-9), size)
        a, b = low + half - centre, high - half - centre
        return F.when(a > b, 0.5 * (a + b)).otherwise(F.greatest(a, F.least(value, b)))

    length, width = F.coalesce("v_length", "length"), F.coalesce("v_width", "width")
    lying = c("length_axis") == "x"
    want = {"x": F.when(lying, length).otherwise(width), "y": F.when(lying, width).otherwise(length)}
    out = []
    for axis, delta in (("x", "width_delta"), ("y", "height_delta")):
        low, high = scaled("", axis)
        outer_low, outer_high = scaled("parent_", axis)
        move = clamped(F.coalesce(f"v_d{axis}", F.lit(0.0)), 0.5 * (low + high), want[axis], outer_low, outer_high)
        out += [move.alias(f"translate_{axis}"), (want[axis] - F.greatest(F.lit(1e-9), high - low)).alias(delta)]
    return rows.select(*DESIGN, "slot_id", *out)


def to_geometry_frame(points: DataFrame, canvas: DataFrame) -> DataFrame:
    """Image frame (y down) to the board frame: ``canvas(contour_id, height, origin_x, origin_y)``."""
    rows = points.join(broadcast_if_small(canvas.select(*KEY, "height", "origin_x", "origin_y")), KEY)
    return rows.select(
        *KEY, "idx", (F.col("x") + F.coalesce("origin_x", F.lit(0.0))).alias("x"),
        (F.coalesce("height", F.lit(0.0)) - F.col("y") + F.coalesce("origin_y", F.lit(0.0))).alias("y"),
    )


def to_image_frame(points: DataFrame, canvas: DataFrame) -> DataFrame:
    """Board frame back to the image frame."""
    rows = points.join(broadcast_if_small(canvas.select(*KEY, "height", "origin_x", "origin_y")), KEY)
    return rows.select(
        *KEY, "idx", (F.col("x") - F.coalesce("origin_x", F.lit(0.0))).alias("x"),
        (F.coalesce("height", F.lit(0.0)) - (F.col("y") - F.coalesce("origin_y", F.lit(0.0)))).alias("y"),
    )


def random_variants(
    points: DataFrame, epochs: int, seed: int = 0, share: float = 0.8, extent: float = 0.05, spans: Spans | None = None
) -> DataFrame:
    """Jittered copies of each outline, one per epoch.

    In every copy the ``share`` of points with the smallest hash moves by whole
    units within half of ``extent`` times the outline's size, the upper end
    left out. All draws come from a stable hash of seed, epoch and point.
    """
    c = F.col
    spans = ensure_spans(points, KEY, "idx", spans)
    sized = with_group(points, KEY, {
        "_n": F.count(F.lit(1)), "_x0": F.min("x"), "_x1": F.max("x"), "_y0": F.min("y"), "_y1": F.max("y"),
    }, spans).withColumn("_wide", c("_x1") - c("_x0")).withColumn("_tall", c("_y1") - c("_y0"))
    copies = sized.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(epochs)))).alias("epoch"))
    draw = lambda stream: stable_unit(seed, stream, c("contour_id"), c("epoch"), c("idx"))
    drawn = copies.select("*", draw(1).alias("_pick"))
    keys = [*KEY, "epoch"]
    # The hash spreads evenly, so a split group is cut by hash range.
    by_hash = measure_spans(drawn, keys, "_pick") if spans else spans
    ranked = with_position(drawn, keys, ["_pick", "idx"], by_hash, "_rank")
    chosen = c("_rank") <= F.floor(c("_n") * share)
    half = lambda size: F.floor(F.floor(size * extent) / 2)
    jitter = lambda stream, size: F.floor(draw(stream) * 2 * half(size)) - half(size)
    move = lambda axis, stream, size: F.when(chosen, c(axis) + jitter(stream, c(size))).otherwise(c(axis)).alias(axis)
    return ranked.select(*keys, "idx", move("x", 2, "_wide"), move("y", 3, "_tall"), chosen.alias("moved"))


