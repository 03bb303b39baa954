"""Primitives, ports, junctions and design variables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.functions.numeric import is_finite, rounded
from sweepfield.plans.components import grid_components
from sweepfield.plans.folds import Columns, fold_groups
from sweepfield.plans.ordered import Spans, ensure_spans, with_group
from sweepfield.plans.sizing import broadcast_if_small

DESIGN = ["design_id"]
# Port connection walk.
STEP, TOUCH, MAX_SHIFT, WIDTH_SCALE = 0.2, 0.15, 120.0, 1.5
# Designs up to this many primitive ends are clustered in one piece.
FOLD_LIMIT = 2_000
CURVE_TYPES = ["ARC", "CURVE", "BSPLINE"]


def primitive_type(raw: Column) -> Column:
    """Normal type name by keyword, in fixed order."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    chain = F.when(text.contains("spline"), "BSPLINE")
    for word, name in (("line", "LINE"), ("arc", "ARC"), ("curve", "CURVE"), ("port", "PORT"), ("feed", "FEEDLINE")):
        chain = chain.when(text.contains(word), name)
    return chain.otherwise("UNKNOWN")


def primitive_summary(rows: DataFrame) -> DataFrame:
    """Nine conditional counts per design from ``type``, ``role`` and ``original_type``."""
    kind, role = F.col("type"), F.col("role")
    return rows.groupBy(*DESIGN).agg(
        F.count(F.lit(1)).alias("primitive_count"),
        F.count_if(kind == "LINE").alias("line_count"),
        F.count_if(kind == "HOLE").alias("hole_count"),
        F.count_if(role == "SLOT").alias("slot_count"),
        F.count_if(kind == "BSPLINE").alias("bspline_count"),
        F.count_if(kind.isin("ARC", "CURVE")).alias("curve_count"),
        F.count_if(F.coalesce(F.col("original_type").isin(CURVE_TYPES), F.lit(False))).alias("linearized_curve_count"),
        F.count_if(role == "PORT").alias("port_count"),
        F.count_if(role == "FEEDLINE").alias("feedline_count"),
    )


def port_zones(boxes: DataFrame) -> DataFrame:
    """Core and neighbour boxes beside the port side of each design.

    ``boxes(design_id, min_x, min_y, max_x, max_y, side)``; an unknown side
    becomes left or bottom by the longer axis. In the image frame top is the
    low-y side; the default bottom keeps the low side.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    width, height = F.greatest(F.lit(1e-9), x1 - x0), F.greatest(F.lit(1e-9), y1 - y0)
    flat = width >= height
    # Which border the boxes grow from.
    border = F.when(F.col("side").isNull(), F.when(flat, "low_x").otherwise("low_y")).when(
        F.col("side") == "left", "low_x").when(F.col("side") == "right", "high_x").when(F.col("side") == "top", "low_y").otherwise("high_y")
    # Depth of the port zone, and of the feed zone behind it.
    mx, my = 0.08 * width, 0.08 * height
    box = lambda a, b, c, d: F.array(a, b, c, d)
    core = (
        F.when(F.col("_b") == "low_x", box(x0 - 1e-6, y0, x0 + mx, y1)).when(F.col("_b") == "high_x", box(x1 - mx, y0, x1 + 1e-6, y1))
        .when(F.col("_b") == "low_y", box(x0, y0 - 1e-6, x1, y0 + my)).otherwise(box(x0, y1 - my, x1, y1 + 1e-6))
    )
    near = (
        F.when(F.col("_b") == "low_x", box(x0 + mx, y0, x0 + 3.0 * mx, y1)).when(F.col("_b") == "high_x", box(x1 - 3.0 * mx, y0, x1 - mx, y1))
        .when(F.col("_b") == "low_y", box(x0, y0 + my, x1, y0 + 3.0 * my)).otherwise(box(x0, y1 - 3.0 * my, x1, y1 - my))
    )
    side = F.coalesce("side", F.when(flat, F.lit("left")).otherwise(F.lit("bottom")))
    zones = boxes.withColumn("_b", border).select("*", core.alias("core"), near.alias("near")).withColumn("side", side).drop("_b")
    return zones


def _in_box(x: Column, y: Column, box: str) -> Column:
    at = lambda i: F.get(box, F.lit(i))
    return x.between(at(0), at(2)) & y.between(at(1), at(3))


def primitive_role(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Role of each primitive from its centre, type and direction.

    ``rows(design_id, primitive_id, type, cx, cy, x1, y1, x2, y2)`` joined with
    the one zone row of its design.
    """
    wanted = zones.select(*DESIGN, "min_x", "min_y", "max_x", "max_y", "core", "near")
    placed = rows.join(broadcast_if_small(wanted), DESIGN)
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    length = F.hypot(dx, dy)
    diagonal = F.greatest(F.lit(1e-9), F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))
    straight = (length > 0.20 * diagonal) & ((dx < 0.15 * length) | (dy < 0.15 * length))
    # Role names and their order.
    role = (
        F.when(_in_box(F.col("cx"), F.col("cy"), "core"), "PORT").when(_in_box(F.col("cx"), F.col("cy"), "near"), "FEEDLINE")
        .when(F.col("type") == "BSPLINE", "RESONANT_SLOT").when((F.col("type") == "LINE") & straight, "FEEDLINE").otherwise("STRUCTURAL")
    )
    return placed.select(*rows.columns, role.alias("role"))


def optimization_mode(kind: Column, role: Column) -> Column:
    """How a primitive may move. The mode names."""
    return (
        F.when(role == "PORT", "FROZEN").when(role == "FEEDLINE", "FEED_DIRECTION_ONLY")
        .when(kind == "LINE", "RIGID_LINE_OFFSET").when(kind == "BSPLINE", "SMOOTH_DEFORM")
        .when(kind.isin("ARC", "CURVE"), "CURVE_SMOOTH_OFFSET").otherwise("DEPENDENT_CACHE_ONLY")
    )


def point_roles(points: DataFrame, keys: list[str], spans: Spans | None = None) -> DataFrame:
    """Endpoint, handle or internal label of each point; handles exist on splines only."""
    spans = ensure_spans(points, keys, "idx", spans)
    rows = with_group(points, keys, {"_low": F.min("idx"), "_high": F.max("idx")}, spans)
    start, end = F.col("idx") - F.col("_low"), F.col("_high") - F.col("idx")
    role = F.when((start == 0) | (end == 0), "ENDPOINT").when(
        (F.col("type") == "BSPLINE") & ((start == 1) | (end == 1)), "HANDLE_POINT"
    ).otherwise("INTERNAL_POINT")
    return rows.select(*points.columns, role.alias("point_role"))


# ---- ports -----------------------------------------------------------------

# Side aliases and key orders of a port summary.
SIDES = {"xmin": "left", "x_min": "left", "xmax": "right", "x_max": "right", "ymin": "top", "y_min": "top", "ymax": "bottom", "y_max": "bottom"}
SIDE_KEYS = ["direction", "port_side", "side"]
POINT_KEYS = ["point", "cst_contact_point", "raw_endpoint", "center"]
WIDTH_KEYS = ["local_width", "feed_width", "width", "port_width"]


def normalize_side(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in SIDES.items() for v in pair]), text), text)
    return F.when(named.isin("left", "right", "top", "bottom"), named)


def resolve_port(df: DataFrame, json: str) -> DataFrame:
    """Side, point and width of the selected port in summary JSON, by key precedence.

    The candidate (selected port, else first listed port, else those of the
    detection block) goes before the summary; the closest edge comes last.
    """
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)

    def candidate(root: str) -> list[Column]:
        picked = get(F.col("_doc"), f"{root}.selected_port", "variant")
        listed = get(F.col("_doc"), f"{root}.ports", "array<variant>")
        return [F.when(is_object(picked), picked), F.get(F.filter(listed, is_object), F.lit(0))]

    rows = df.withColumn("_doc", F.try_parse_json(json)).withColumn(
        "_port", F.coalesce(*candidate("$"), *candidate("$.patch_port_detection"))
    )
    sources = [F.col("_port"), F.col("_doc")]
    sides = [normalize_side(get(s, f"$.{k}", "string")) for s in sources for k in SIDE_KEYS]
    borders = F.transform(get(F.col("_doc"), "$.closest_border_sides", "array<string>"), normalize_side)
    side = F.coalesce(*sides, F.get(F.filter(borders, lambda s: s.isNotNull()), F.lit(0)))

    def point(source: Column, path: str) -> Column:
        x, y = get(source, f"{path}[0]", "double"), get(source, f"{path}[1]", "double")
        return F.when(is_finite(x) & is_finite(y), F.struct(x.alias("x"), y.alias("y")))

    points = [point(s, f"$.{k}") for s in sources for k in POINT_KEYS]
    a, b = point(F.col("_doc"), "$.closest_edge[0]"), point(F.col("_doc"), "$.closest_edge[1]")
    both = a.isNotNull() & b.isNotNull()
    middle = F.when(both, F.struct((0.5 * (a["x"] + b["x"])).alias("x"), (0.5 * (a["y"] + b["y"])).alias("y")))
    widths = [get(s, f"$.{k}", "double") for s in sources for k in WIDTH_KEYS]
    positive = [F.when(is_finite(w) & (w > 0), w) for w in widths]
    edge_width = F.when(both, F.greatest(F.lit(1.0), F.hypot(b["x"] - a["x"], b["y"] - a["y"])))
    spot = F.coalesce(*points, middle)
    kept = [c for c in df.columns if c != json]
    return rows.select(
        *kept, side.alias("side"), spot["x"].alias("port_x"), spot["y"].alias("port_y"), F.coalesce(*positive, edge_width).alias("port_width")
    )


def inward(side: Column) -> tuple[Column, Column]:
    """Unit normal into the board; y grows downward."""
    nx = F.when(side == "left", 1.0).when(side == "right", -1.0).when(side.isin("top", "bottom"), 0.0)
    ny = F.when(side == "top", 1.0).when(side == "bottom", -1.0).when(side.isin("left", "right"), 0.0)
    return nx, ny


def shift_inward(x: Column, y: Column, side: Column, offset: Column) -> tuple[Column, Column]:
    """Point moved along the inward normal; unusable offsets or sides leave it in place."""
    nx, ny = inward(side)
    usable = F.coalesce(is_finite(offset) & (offset > 0) & nx.isNotNull(), F.lit(False))
    return F.when(usable, x + nx * offset).otherwise(x), F.when(usable, y + ny * offset).otherwise(y)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment with clamped projection."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, size)))
    return F.when(size <= 1e-18, F.hypot(px - ax, py - ay)).otherwise(F.hypot(px - (ax + t * dx), py - (ay + t * dy)))


def _edge_cols() -> list[Column]:
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


def distance_to_polyline(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Distance from each design's point to its nearest edge.

    ``points(design_id, px, py)`` has one row per design, so the join keeps the
    size of ``edges``.
    """
    met = edges.join(broadcast_if_small(points.select(*DESIGN, "px", "py")), DESIGN)
    return met.groupBy(*DESIGN).agg(F.min(segment_distance(F.col("px"), F.col("py"), *_edge_cols())).alias("distance"))


def connect_port(
    ports: DataFrame, edges: DataFrame, step: float = STEP, tol: float = TOUCH, max_shift: float = MAX_SHIFT, scale: float = WIDTH_SCALE
) -> DataFrame:
    """Walk each port inward until it touches an edge.

    ``ports(design_id, side, port_x, port_y, port_width)``. The walk follows an
    axis, so an edge can only be touched at the few steps whose coordinate
    falls into its padded box; only those steps are tried.
    """
    limit = -int(-max_shift // step)
    rows = edges.join(broadcast_if_small(ports.select(*DESIGN, "side", "port_x", "port_y")), DESIGN)
    nx, ny = inward(F.col("side"))
    x1, y1, x2, y2 = _edge_cols()
    along = F.col("side").isin("left", "right")
    sign = F.when(along, nx).otherwise(ny)
    here = F.when(along, F.col("port_x")).otherwise(F.col("port_y"))
    across = F.when(along, F.col("port_y")).otherwise(F.col("port_x"))
    lo, hi = F.when(along, F.least(x1, x2)).otherwise(F.least(y1, y2)), F.when(along, F.greatest(x1, x2)).otherwise(F.greatest(y1, y2))
    side_lo, side_hi = F.when(along, F.least(y1, y2)).otherwise(F.least(x1, x2)), F.when(along, F.greatest(y1, y2)).otherwise(F.greatest(x1, x2))
    pad = tol + 1e-9
    a, b = (lo - pad - here) * sign / step, (hi + pad - here) * sign / step
    first = F.greatest(F.lit(0), F.floor(F.least(a, b))).cast("long")
    last = F.least(F.lit(limit), F.ceil(F.greatest(a, b))).cast("long")
    reachable = nx.isNotNull() & across.between(side_lo - pad, side_hi + pad) & (last >= first)
    tried = rows.filter(reachable).select("*", nx.alias("_nx"), ny.alias("_ny"), F.explode(F.sequence(first, last)).alias("_k"))
    shift = F.col("_k") * F.lit(step)
    gap = segment_distance(F.col("port_x") + F.col("_nx") * shift, F.col("port_y") + F.col("_ny") * shift, x1, y1, x2, y2)
    touched = tried.withColumn("_gap", gap).filter(F.col("_gap") <= tol).groupBy(*DESIGN).agg(F.min("_k").alias("_k"))
    drawn = edges.select(*DESIGN).distinct().withColumn("_drawn", F.lit(True))
    out = ports.join(touched, DESIGN, "left").join(drawn, DESIGN, "left")
    nx, ny = inward(F.col("side"))
    usable = nx.isNotNull() & F.col("port_x").isNotNull() & F.col("_drawn").isNotNull()
    steps = F.when(usable, F.coalesce("_k", F.lit(limit).cast("long")))
    moved = steps * F.lit(step)
    status = (
        F.when(nx.isNull(), "failed_unknown_port_side").when(F.col("port_x").isNull(), "failed_no_port_point")
        .when(F.col("_drawn").isNull(), "failed_no_geometry_polylines").when(F.col("_k") == 0, "already_connected")
        .when(F.col("_k") > 0, "connected_by_inward_shift").otherwise("failed_no_curve_contact_within_max_shift")
    )
    return out.select(
        *DESIGN, status.alias("status"), F.coalesce(moved, F.lit(0.0)).alias("shift"),
        F.when(usable, F.col("port_x") + nx * moved).otherwise(F.col("port_x")).alias("point_x"),
        F.when(usable, F.col("port_y") + ny * moved).otherwise(F.col("port_y")).alias("point_y"),
        F.when(usable, F.col("port_width") * scale).otherwise(F.col("port_width")).alias("width"),
    )


def feed_rules_score(df: DataFrame) -> DataFrame:
    """Six soft rules on a feed's shape with total, validity and confidence."""
    num = lambda name, default=0.0: F.coalesce(F.when(F.col(name) != 0, F.col(name)), F.lit(default))
    mean, deviation, low, high = num("mean_width"), num("width_std"), num("min_width"), num("max_width")
    aspect, bend, length = num("feed_aspect_ratio"), num("branch_tortuosity", 99.0), num("branch_length")
    # Rule names, limits and points.
    scores = {
        "width_stability": F.when(deviation / F.greatest(mean, F.lit(1e-6)) < 0.35, 2.0).otherwise(-2.0),
        "width_range": F.when(high / F.greatest(low, F.lit(1e-6)) < 2.0, 1.5).otherwise(-1.5),
        "aspect_ratio": F.when(aspect > 3.0, 3.0).when(aspect < 1.5, -3.0).otherwise(0.5),
        "straightness": F.when(bend < 1.15, 2.0).when(bend > 1.4, -2.5).otherwise(0.5),
        "patch_transition": F.when(F.coalesce("patch_transition_detected", F.lit(False)), 3.0).otherwise(0.0),
        "minimum_stub_length": F.when(length < F.greatest(F.lit(6.0), mean * 1.2), -2.0).otherwise(1.0),
    }
    total = sum(scores.values(), F.lit(0.0))
    return df.select(
        "*", *[s.alias(name) for name, s in scores.items()], rounded(total, 3).alias("total_score"),
        ((total >= 1.0) & (aspect >= 1.0) & (length >= 3.0)).alias("em_valid"),
        rounded(F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.55 + total / 12.0)), 3).alias("confidence_scale"),
    )


# ---- junctions -------------------------------------------------------------


def junctions(endpoints: DataFrame, tol: float = 1.0, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Greedy clusters of primitive ends with at least two members.

    ``endpoints(design_id, seq, x, y)`` in ``seq`` order: an end joins the first
    cluster whose running mean lies within ``tol``. The rule depends on order,
    so it is folded: designs up to ``fold_limit`` ends in one piece, larger ones
    only inside groups of touching grid cells. A cluster of n members keeps all of them within ``tol * (2 + H(n))`` of any joining
    end, which sets the cell size; ends further apart can never meet.
    """
    most = endpoints.groupBy(*DESIGN).agg(F.count(F.lit(1)).alias("_n"))
    reach = tol * (3.0 + F.log("_n")) + 1e-9
    rows = endpoints.join(most, DESIGN).select(
        *endpoints.columns, F.floor(F.col("x") / reach).cast("long").alias("cell_x"), F.floor(F.col("y") / reach).cast("long").alias("cell_y")
    )
    whole = lambda df: df.select(*DESIGN, "seq", "x", "y", *[F.lit(0).cast("long").alias(c) for c in ("region_x", "region_y")])
    large = most.filter(F.col("_n") > fold_limit)
    if large.isEmpty():
        placed = whole(endpoints)
    else:
        big = rows.join(large.select(*DESIGN), DESIGN, "left_semi")
        regions = grid_components(big.select(*DESIGN, "cell_x", "cell_y"), DESIGN)
        placed = big.join(regions, [*DESIGN, "cell_x", "cell_y"]).select(
            *DESIGN, "seq", "x", "y", F.col("region.x").alias("region_x"), F.col("region.y").alias("region_y")
        ).unionByName(whole(endpoints.join(large, DESIGN, "left_anti")))

    def cluster(group: Columns) -> Columns | None:
        count = len(group["seq"])
        sums, sizes, used = np.zeros((count, 2)), np.ones(count), 0
        own = np.empty(count, dtype="int64")
        for i, point in enumerate(np.column_stack([group["x"], group["y"]])):
            away = point - sums[:used] / sizes[:used, None]
            near = np.flatnonzero(np.hypot(away[:, 0], away[:, 1]) <= tol)
            if near.size:
                own[i] = near[0]
                sizes[near[0]] += 1
            else:
                own[i] = used
                used += 1
            sums[own[i]] += point
        members = np.bincount(own)[own]
        first = group["seq"][np.unique(own, return_index=True)[1]][own]
        keep = members >= 2
        if not keep.any():
            return None
        return {
            "design_id": group["design_id"][keep], "junction": first[keep], "seq": group["seq"][keep],
            "x": group["x"][keep], "y": group["y"][keep], "members": members[keep],
        }

    found = fold_groups(
        placed, [*DESIGN, "region_x", "region_y"], ["seq"], cluster,
        "design_id long, junction long, seq long, x double, y double, members long",
    )
    shared = found.groupBy(*DESIGN, "junction").agg(F.avg("x").alias("shared_x"), F.avg("y").alias("shared_y"))
    return found.join(shared, [*DESIGN, "junction"])


def sync_junctions(members: DataFrame) -> DataFrame:
    """Move each member to its junction's target: the ports' mean if any, else everyone's."""
    key = [*DESIGN, "junction"]
    port = F.col("role") == "PORT"
    target = members.groupBy(*key).agg(
        F.coalesce(F.avg(F.when(port, F.col("x"))), F.avg("x")).alias("target_x"),
        F.coalesce(F.avg(F.when(port, F.col("y"))), F.avg("y")).alias("target_y"),
    )
    return members.join(target, key)


def broken_junctions(members: DataFrame, tol: float = 1.0) -> DataFrame:
    """Junctions whose farthest member lies beyond ``tol`` of their mean."""
    key = [*DESIGN, "junction"]
    mean = members.groupBy(*key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("_n"))
    gap = F.max(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    return members.join(mean, key).filter(F.col("_n") >= 2).groupBy(*key).agg(gap.alias("max_gap")).filter(F.col("max_gap") > tol)


# ---- design variables ------------------------------------------------------


def _variable(name: str, kind: str, lower: Column, upper: Column, default: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("suffix"), F.lit(kind).alias("variable_type"), lower.alias("lower"), upper.alias("upper"),
        (F.lit(0.0) if default is None else default).alias("default"),
    )


def variable_plan_primitives(rows: DataFrame, boxes: DataFrame, cap: int | None = None) -> DataFrame:
    """Variables of holes (4), other lines (1) and port lines (2), in that order.

    ``rows(design_id, primitive_id, seq, type, role, min_x, min_y, max_x, max_y,
    length)``; ``boxes`` gives each design's extent.
    """
    c = F.col
    extent = boxes.select(
        *DESIGN, F.greatest(F.lit(10.0), F.hypot(c("max_x") - c("min_x"), c("max_y") - c("min_y"))).alias("scale")
    )
    sized = rows.join(broadcast_if_small(extent), DESIGN)
    clamp = lambda low, high, v: F.greatest(F.lit(low), F.least(F.lit(high), v))
    move = clamp(0.25, 3.0, 0.04 * c("scale"))
    wide, tall = clamp(0.10, 3.0, 0.50 * (c("max_x") - c("min_x"))), clamp(0.10, 3.0, 0.50 * (c("max_y") - c("min_y")))
    offset = F.when(c("role").isin("FEEDLINE", "PORT"), 0.018).otherwise(0.018 * 1.25) * c("scale")
    width = F.greatest(F.lit(1.0), c("length"))
    shift = F.greatest(F.lit(2.0), F.least(0.05 * width, 0.005 * c("scale")))
    hole = F.array(
        _variable("slot_translate_x", "hole_translate_x", -move, move), _variable("slot_translate_y", "hole_translate_y", -move, move),
        _variable("slot_width_delta", "hole_resize_width", -wide, wide), _variable("slot_height_delta", "hole_resize_height", -tall, tall),
    )
    line = F.array(_variable("normal_offset", "line_normal_offset", -offset, offset))
    port = F.array(
        _variable("port_width_delta", "port_width_delta", F.lit(0.0), 0.20 * width),
        _variable("port_propagation_shift", "port_propagation_shift", -shift, shift),
    )
    is_hole = (c("type") == "HOLE") | (c("role") == "SLOT")
    is_line = c("type") == "LINE"
    kind = F.when(is_hole, 0).when(is_line & (c("role") != "PORT"), 1).when(is_line, 2)
    plan = F.when(c("kind") == 0, hole).when(c("kind") == 1, line).otherwise(port)
    names = sized.withColumn("kind", kind).filter(c("kind").isNotNull()).select(
        *DESIGN, "primitive_id", "kind", "seq", F.posexplode(plan).alias("part", "v")
    )
    safe = F.translate(c("primitive_id"), "-|.", "___")
    out = names.select(
        *DESIGN, F.concat_ws("_", safe, "v.suffix").alias("name"), "primitive_id", "v.variable_type", "v.lower", "v.upper", "v.default",
        "kind", "seq", "part",
    )
    if cap is not None:
        order = Window.partitionBy(*DESIGN).orderBy("kind", "seq", "part")
        out = out.withColumn("_k", F.row_number().over(order)).filter(c("_k") <= cap).drop("_k")
    return out


def variable_plan_slots(
    slots: DataFrame, boards: DataFrame, slot_scale: tuple[float, float] = (0.5, 1.5), global_scale: tuple[float, float] = (0.8, 1.5), margin: float = 0.0
) -> DataFrame:
    """Two whole-model scales and four variables per slot.

    ``slots(design_id, slot_id, min_x…max_y, parent_min_x…parent_max_y)`` with
    nullable parents; ``boards(design_id, min_x…max_y)``. Moves keep the slot
    inside its parent or board; inverted bounds collapse to their middle.
    """
    c = F.col
    board = boards.select(*DESIGN, *[c(n).alias(f"board_{n}") for n in ("min_x", "min_y", "max_x", "max_y")])
    rows = slots.join(broadcast_if_small(board), DESIGN)

    def bounds(axis: str) -> tuple[Column, Column]:
        known = c("parent_min_x").isNotNull()
        lo = F.when(known, c(f"parent_min_{axis}")).otherwise(c(f"board_min_{axis}"))
        hi = F.when(known, c(f"parent_max_{axis}")).otherwise(c(f"board_max_{axis}"))
        a, b = lo + margin - c(f"min_{axis}"), hi - margin - c(f"max_{axis}")
        return F.when(a > b, 0.5 * (a + b)).otherwise(a), F.when(a > b, 0.5 * (a + b)).otherwise(b)

    sx, sy = F.greatest(F.lit(1e-9), c("max_x") - c("min_x")), F.greatest(F.lit(1e-9), c("max_y") - c("min_y"))
    length, width = F.greatest(sx, sy), F.least(sx, sy)
    low, high = slot_scale
    four = F.array(
        _variable("dx", "slot_dx", *bounds("x")), _variable("dy", "slot_dy", *bounds("y")),
        _variable("length", "slot_length", length * low, length * high, length), _variable("width", "slot_width", width * low, width * high, width),
    )
    local = rows.select(*DESIGN, "slot_id", F.explode(four).alias("v")).select(
        *DESIGN, F.concat_ws("_", "slot_id", "v.suffix").alias("name"), "slot_id", F.lit("slot").alias("target"),
        "v.variable_type", "v.lower", "v.upper", "v.default",
    )
    both = F.array(*[
        _variable(n, n, F.lit(float(global_scale[0])), F.lit(float(global_scale[1])), F.lit(1.0)) for n in ("global_scale_x", "global_scale_y")
    ])
    whole = boards.select(*DESIGN, F.explode(both).alias("v")).select(
        *DESIGN, c("v.suffix").alias("name"), F.lit(None).cast("string").alias("slot_id"), F.lit("model").alias("target"),
        "v.variable_type", "v.lower", "v.upper", "v.default",
    )
    return whole.unionByName(local)


def variable_groups(variables: DataFrame) -> DataFrame:
    """Names of each design's variables by target, type and slot, each list one row in ``seq`` order."""
    unknown = lambda v: F.coalesce(F.when(F.col(v) != "", F.col(v)), F.lit("unknown"))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("grouping"), value.alias("value"))
    tagged = variables.select(*DESIGN, "seq", "name", F.inline(F.array(
        entry("target", unknown("target")), entry("type", unknown("variable_type")), entry("slot", F.col("slot_id"))
    ))).filter(F.col("value").isNotNull())
    return tagged.groupBy(*DESIGN, "grouping", "value").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda s: s["name"]).alias("names")
    )


# ---- designs ---------------------------------------------------------------


def infer_patch_box(outline: DataFrame, feed: DataFrame) -> DataFrame:
    """Outline box cut at the feed line: ``outline(design_id, min_x…max_y)``, ``feed(design_id, direction, x, y, width, length)``."""
    c = F.col
    fed = feed.select(*DESIGN, F.lower("direction").alias("direction"), c("x").alias("feed_x"), c("y").alias("feed_y"), c("width").alias("feed_width"), c("length").alias("feed_length"))
    rows = outline.join(fed, DESIGN, "left")
    cut = lambda side, own, at: F.when((c("direction") == side) & at.isNotNull(), at).otherwise(c(own)).alias(own)
    keep = ["direction", "feed_x", "feed_y", "feed_width", "feed_length"]
    return rows.select(
        *DESIGN, cut("left", "min_x", c("feed_x")), cut("bottom", "min_y", c("feed_y")),
        cut("right", "max_x", c("feed_x")), cut("top", "max_y", c("feed_y")), *keep,
    )


def design_summary(outline: DataFrame, feed: DataFrame, slots: DataFrame) -> DataFrame:
    """Patch size and centre, feed offset and slot totals of each design."""
    c = F.col
    box = infer_patch_box(outline, feed)
    area = (c("max_x") - c("min_x")) * (c("max_y") - c("min_y"))
    held = slots.groupBy(*DESIGN).agg(F.count(F.lit(1)).alias("slot_count"), F.sum("area").alias("slot_area"))
    cx, cy = (c("min_x") + c("max_x")) / 2.0, (c("min_y") + c("max_y")) / 2.0
    offset = F.when(c("direction").isin("top", "bottom"), c("feed_x") - cx).when(c("direction").isin("left", "right"), c("feed_y") - cy)
    return box.join(held, DESIGN, "left").select(
        *DESIGN, rounded(c("max_y") - c("min_y")).alias("length"), rounded(c("max_x") - c("min_x")).alias("width"),
        rounded(cx).alias("center_x"), rounded(cy).alias("center_y"), rounded(area).alias("patch_area"),
        F.coalesce("direction", F.lit("unknown")).alias("feed_direction"), rounded(offset).alias("feed_offset"),
        F.coalesce("slot_count", F.lit(0)).cast("long").alias("slot_count"), rounded(F.coalesce("slot_area", F.lit(0.0))).alias("slot_area"),
    )


C0_M_PER_S = 299_792_458.0  # fixed value: speed of light


def electrical_size(df: DataFrame, freq_ghz: str = "target_freq", eps: str = "epsilon_r") -> DataFrame:
    """Patch ``length`` and ``width`` in millimetres over free-space and guided wavelength."""
    free = F.try_divide(F.lit(C0_M_PER_S), F.col(freq_ghz) * 1e9) * 1000.0
    guided = F.when(F.col(eps) > 0, F.try_divide(free, F.sqrt(F.col(eps))))
    over = lambda size, wave, name: rounded(F.try_divide(F.col(size), wave)).alias(name)
    return df.select(
        "*", rounded(free).alias("lambda0"), over("length", free, "length_lambda0"), over("width", free, "width_lambda0"),
        rounded(guided).alias("lambda_g"), over("length", guided, "length_lambda_g"), over("width", guided, "width_lambda_g"),
    )


def find_component(components: DataFrame, keyword: str) -> DataFrame:
    """First component of each design whose name or roles contain the keyword.

    ``components(design_id, comp, name, role, primitive_roles array<string>,
    min_x…max_y)``.
    """
    has = lambda v: F.coalesce(F.lower(v).contains(keyword.lower()), F.lit(False))
    hit = has(F.col("name")) | has(F.col("role")) | F.coalesce(F.exists("primitive_roles", has), F.lit(False))
    box = F.struct("comp", "min_x", "min_y", "max_x", "max_y")
    return components.filter(hit).groupBy(*DESIGN).agg(F.min_by(box, "comp").alias("b")).select(*DESIGN, "b.*")


def infer_feed(components: DataFrame, tol: float = 1e-7) -> DataFrame:
    """Edge feed of each design from its patch and feed boxes.

    The side follows which edges touch, in eight ordered rules; the span is the
    positive overlap. A feed that touches nothing gives nulls.
    """
    c = F.col
    name = lambda p: [c(n).alias(f"{p}{n}") for n in ("min_x", "min_y", "max_x", "max_y")]
    rows = find_component(components, "patch").select(*DESIGN, *name("p_")).join(
        find_component(components, "feed").select(*DESIGN, *name("f_")), DESIGN
    )
    near = lambda a, b: F.abs(c(a) - c(b)) <= tol
    over_x = (c("f_max_x") > c("p_min_x")) & (c("f_min_x") < c("p_max_x"))
    over_y = (c("f_max_y") > c("p_min_y")) & (c("f_min_y") < c("p_max_y"))
    side = (
        F.when(near("f_max_y", "p_min_y"), "bottom").when(near("f_min_y", "p_min_y") & over_x, "bottom")
        .when(near("f_min_y", "p_max_y"), "top").when(near("f_max_y", "p_max_y") & over_x, "top")
        .when(near("f_max_x", "p_min_x"), "left").when(near("f_min_x", "p_min_x") & over_y, "left")
        .when(near("f_min_x", "p_max_x"), "right").when(near("f_max_x", "p_max_x") & over_y, "right")
    )
    level = c("side").isin("bottom", "top")
    a = F.when(level, F.greatest("f_min_x", "p_min_x")).otherwise(F.greatest("f_min_y", "p_min_y"))
    b = F.when(level, F.least("f_max_x", "p_max_x")).otherwise(F.least("f_max_y", "p_max_y"))
    ok = c("side").isNotNull() & (b > a)
    middle = (a + b) / 2.0
    x = F.when(level, middle).when(c("side") == "left", c("p_min_x")).otherwise(c("p_max_x"))
    y = F.when(c("side") == "bottom", c("p_min_y")).when(c("side") == "top", c("p_max_y")).otherwise(middle)
    out = (
        F.when(c("side") == "bottom", c("p_min_y") - c("f_min_y")).when(c("side") == "top", c("f_max_y") - c("p_max_y"))
        .when(c("side") == "left", c("p_min_x") - c("f_min_x")).otherwise(c("f_max_x") - c("p_max_x"))
    )
    return rows.withColumn("side", side).select(
        *DESIGN, F.when(ok, c("side")).alias("direction"), F.when(ok, x).alias("x"), F.when(ok, y).alias("y"),
        F.when(ok, b - a).alias("width"), F.when(ok, F.greatest(F.lit(0.0), out)).alias("length"),
    )


def port_from_feed(boxes: DataFrame, feed: DataFrame) -> DataFrame:
    """Port point, edge and width from the feed, or the bottom centre with 8 % width.

    ``feed(design_id, direction, width, x, y, terminal_x, terminal_y)``.
    """
    c = F.col
    fed = feed.select(
        *DESIGN, F.lower("direction").alias("direction"), c("width").alias("fw"),
        F.coalesce("terminal_x", "x").alias("fx"), F.coalesce("terminal_y", "y").alias("fy"), F.lit(True).alias("fed"),
    )
    rows = boxes.join(fed, DESIGN, "left").withColumn("fed", F.coalesce("fed", F.lit(False)))
    width = F.when(c("fed"), F.greatest(F.lit(2.0), F.coalesce("fw", F.lit(2.0)))).otherwise(F.greatest(F.lit(2.0), (c("max_x") - c("min_x")) * 0.08))
    x = F.when(c("fed"), c("fx")).otherwise((c("min_x") + c("max_x")) / 2.0)
    y = F.when(c("fed"), c("fy")).otherwise(c("min_y"))
    direction = F.when(c("fed"), F.coalesce("direction", F.lit("bottom"))).otherwise("bottom")
    level = direction.isin("top", "bottom")
    dx, dy = F.when(level, width / 2.0).otherwise(0.0), F.when(level, 0.0).otherwise(width / 2.0)
    return rows.select(
        *DESIGN, direction.alias("direction"), width.alias("width"), x.alias("port_x"), y.alias("port_y"),
        (x - dx).alias("edge_x1"), (y - dy).alias("edge_y1"), (x + dx).alias("edge_x2"), (y + dy).alias("edge_y2"),
        F.when(c("fed"), "feed").otherwise("synthetic_bottom_edge_center").alias("source"),
    )
