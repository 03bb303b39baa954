"""Segmentation of ordered points into lines, arcs and splines.

Point tables hold ``contour_id, idx, x, y``; segment tables add ``segment``.
Neighbouring segments share their boundary point, as one row in each.
"""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.numeric import clip
from sweepfield.operators import contours
from sweepfield.plans.blocks import fold_in_blocks, in_blocks
from sweepfield.plans.folds import Columns, fold_groups
from sweepfield.plans.ordered import (
    Spans,
    ensure_spans,
    with_islands,
    with_neighbours,
    with_running,
)
from sweepfield.session import shared_folder

KEY = ["contour_id"]
SEGMENT = ["contour_id", "segment"]
LINE_LIMIT, ARC_LIMIT = 2.0, 2.0
MIN_CHORD, MIN_RADIUS, MIN_LENGTH = 8.0, 3.0, 8.0


def _turn() -> Column:
    ax, ay = F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")
    bx, by = F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y")
    return F.acos(clip((ax * bx + ay * by) / (F.hypot(ax, ay) * F.hypot(bx, by) + 1e-8), -1.0, 1.0))


def discrete_curvature(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Turning angle of inner points; the ends repeat their neighbour, short curves give 0."""
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = contours.linked(points, spans)
    bent = rows.select(*points.columns, F.when(~F.col("is_first") & ~F.col("is_last"), _turn()).alias("bend"))
    padded = with_neighbours(bent, KEY, ["idx"], ["bend"], spans)
    return padded.select(*points.columns, F.coalesce("bend", "next.bend", "prev.bend", F.lit(0.0)).alias("curvature"))


def _candidates(points: DataFrame, threshold: float, spans: Spans) -> DataFrame:
    """Points with ``steps``: whether curvature jumps between the point before and this one."""
    bent = with_neighbours(discrete_curvature(points, spans), KEY, ["idx"], ["curvature"], spans, next=None)
    jump = F.abs(F.col("curvature") - F.col("prev.curvature")) > threshold
    return bent.select(*points.columns, F.coalesce(jump, F.lit(False)).alias("breaks"))


def _numbered(rows: DataFrame, columns: list[str], spans: Spans) -> DataFrame:
    """Segment numbers from ``breaks`` flags; a break also ends the segment before it."""
    cut = with_islands(rows, KEY, ["idx"], F.col("breaks"), spans, "segment")
    both = F.when(F.col("breaks"), F.array(F.col("segment") - 1, F.col("segment"))).otherwise(F.array("segment"))
    return cut.select(*columns, F.explode(both).alias("segment"))


def split_on_curvature(points: DataFrame, threshold: float = 0.15, spans: Spans | None = None) -> DataFrame:
    """Cut wherever the curvature step exceeds the threshold."""
    spans = ensure_spans(points, KEY, "idx", spans)
    return _numbered(_candidates(points, threshold, spans), points.columns, spans)


def split_min_points(
    points: DataFrame, threshold: float = 0.15, min_points: int = 10, spans: Spans | None = None
) -> DataFrame:
    """The same cuts, but each only ``min_points`` after the last accepted one.

    A candidate that far behind the candidate before it is accepted whatever
    came earlier. Candidates are cut into runs there, and a run is folded in
    order, a long one in blocks that carry the last accepted place. A short
    tail joins the segment before it.
    """
    shared_folder(points.sparkSession)
    spans = ensure_spans(points, KEY, "idx", spans)
    flagged = _candidates(points, threshold, spans)
    reach = min_points - 1
    # A few places per outline, used again and again: the points are searched once.
    marks = flagged.filter(F.col("breaks") | (F.col("idx") == 0)).select(*KEY, "idx").checkpoint()
    linked = with_neighbours(marks, KEY, ["idx"], ["idx"], spans, next=None)
    fresh = F.col("prev").isNull() | (F.col("idx") - F.col("prev.idx") >= reach)
    runs = with_islands(linked, KEY, ["idx"], fresh, spans, "run").select(*KEY, "run", "idx")

    def walk(group: Columns):
        """Accepted places of a block, and the last one accepted so far."""
        last, kept = (group["held_idx"][0] if group["held"][0] else None), []
        for place in group["idx"]:
            if last is None or place - last >= reach:
                kept.append(place)
                last = place
        return kept, last

    def leave(group: Columns) -> Columns:
        return {"held": np.array([True]), "held_idx": np.array([walk(group)[1]])}

    def close(group: Columns) -> Columns | None:
        kept, _ = walk(group)
        return {"contour_id": group["contour_id"][0], "idx": np.array(kept)} if kept else None

    state = {"held": ("boolean", False), "held_idx": ("bigint", 0)}
    cut = in_blocks(runs, [*KEY, "run"], ["idx"], spans)
    accepted = fold_in_blocks(cut, [*KEY, "run"], ["idx"], leave, close, state, "contour_id long, idx long").filter(F.col("idx") > 0).checkpoint()
    ends = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    tails = accepted.groupBy(*KEY).agg(F.max("idx").alias("idx")).join(ends, KEY).filter(F.col("_n") - F.col("idx") < min_points)
    breaks = accepted.join(tails.select(*KEY, "idx"), [*KEY, "idx"], "left_anti").withColumn("_hit", F.lit(True))
    rows = points.join(breaks, [*KEY, "idx"], "left").select(*points.columns, F.coalesce("_hit", F.lit(False)).alias("breaks"))
    return _numbered(rows, points.columns, spans)


def line_fit_chord(segments: DataFrame) -> DataFrame:
    """Largest distance of each segment's points to its chord; 0 for a degenerate chord."""
    spot = F.struct("x", "y")
    ends = segments.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(spot, "idx").alias("a"), F.max_by(spot, "idx").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    chord = F.hypot(dx, dy)
    away = F.try_divide(F.abs(dx * (F.col("y") - a["y"]) - dy * (F.col("x") - a["x"])), chord)
    found = segments.join(ends, SEGMENT).groupBy(*SEGMENT, "n", "a", "b").agg(F.max(F.when(chord >= 1e-6, away).otherwise(0.0)).alias("_e"))
    return found.select(
        *SEGMENT, "n", F.when(F.col("n") < 2, F.lit(float("inf"))).otherwise(F.col("_e")).alias("line_error"), chord.alias("chord")
    )


def line_fit_pca(
    segments: DataFrame, linearity: float = 0.02, residual: float = 1.0, turn: float = 10.0, spans: Spans | None = None
) -> DataFrame:
    """Principal-axis line test: singular-value ratio, largest residual and total turn.

    The axis comes in closed form from the covariances of one aggregate.
    """
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    c = F.col
    moments = segments.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
    )
    half = F.hypot((c("xx") - c("yy")) / 2, c("xy"))
    mean = (c("xx") + c("yy")) / 2
    axes = moments.select(
        *SEGMENT, "n", "mx", "my",
        F.sqrt(c("n") * (mean + half)).alias("s0"), F.sqrt(c("n") * F.greatest(F.lit(0.0), mean - half)).alias("s1"),
        (F.atan2(2 * c("xy"), c("xx") - c("yy")) / 2).alias("angle"),
    )
    away = F.abs((c("y") - c("my")) * F.cos("angle") - (c("x") - c("mx")) * F.sin("angle"))
    residuals = segments.join(axes, SEGMENT).groupBy(*SEGMENT, "n", "s0", "s1").agg(F.max(away).alias("max_residual"))
    bends = with_neighbours(segments, SEGMENT, ["idx"], ["x", "y"], spans).filter(c("prev").isNotNull() & c("next").isNotNull())
    turns = bends.groupBy(*SEGMENT).agg(F.degrees(F.sum(_turn())).alias("total_turn"))
    pair = c("n") == 2
    rows = residuals.join(turns, SEGMENT, "left").select(
        *SEGMENT, "n", "s0", F.when(pair, 0.0).otherwise(c("s1") / (c("s0") + 1e-9)).alias("linearity"),
        F.when(pair, 0.0).otherwise(c("max_residual")).alias("max_residual"), F.coalesce("total_turn", F.lit(0.0)).alias("total_turn"),
    )
    straight = pair | (
        (c("n") > 2) & (c("s0") >= 1e-9) & (c("linearity") < linearity) & (c("max_residual") < residual) & (c("total_turn") < turn)
    )
    return rows.select(*SEGMENT, "n", "linearity", "max_residual", "total_turn", straight.alias("is_line"))


def _circles(segments: DataFrame) -> DataFrame:
    """Least-squares circle centre of each segment, from centred sums of one aggregate."""
    c = F.col
    means = segments.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = c("x") - c("mx"), c("y") - c("my")
    sums = segments.join(means, SEGMENT).groupBy(*SEGMENT, "n", "mx", "my").agg(
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"),
        (F.sum(u * (u * u + v * v)) / 2).alias("p"), (F.sum(v * (u * u + v * v)) / 2).alias("q"),
    )
    det = c("uu") * c("vv") - c("uv") * c("uv")
    solved = F.abs(det) > 1e-12 * F.greatest(c("uu") * c("vv"), F.lit(1e-300))
    return sums.select(
        *SEGMENT, "n", solved.alias("solved"),
        (c("mx") + F.when(solved, F.try_divide(c("p") * c("vv") - c("q") * c("uv"), det)).otherwise(0.0)).alias("cx"),
        (c("my") + F.when(solved, F.try_divide(c("q") * c("uu") - c("p") * c("uv"), det)).otherwise(0.0)).alias("cy"),
    )


def circle_fit(
    segments: DataFrame, radius_spread: float = 0.05, normal_spread: float = 0.1, spans: Spans | None = None
) -> DataFrame:
    """Least-squares circle with its largest error; infinite unless radius and normals are steady."""
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    c = F.col
    rows = segments.join(_circles(segments).filter((c("n") >= 3) & c("solved")), SEGMENT)
    gx, gy = c("x") - c("cx"), c("y") - c("cy")
    reach = F.hypot(gx, gy)
    placed = rows.select(*SEGMENT, "idx", "n", "cx", "cy", reach.alias("d"), (gx / F.greatest(reach, F.lit(1e-9))).alias("nx"), (gy / F.greatest(reach, F.lit(1e-9))).alias("ny"))
    steps = with_neighbours(placed, SEGMENT, ["idx"], ["nx", "ny"], spans, next=None)
    angle = F.acos(clip(c("nx") * c("prev.nx") + c("ny") * c("prev.ny"), -1.0, 1.0))
    found = steps.groupBy(*SEGMENT, "n", "cx", "cy").agg(
        F.sqrt(F.avg(c("d") * c("d"))).alias("radius"), F.stddev_pop("d").alias("_spread"),
        F.min("d").alias("_low"), F.max("d").alias("_high"), F.stddev_pop(F.when(c("prev").isNotNull(), angle)).alias("_normals"),
    )
    worst = F.greatest(F.abs(c("_high") - c("radius")), F.abs(c("_low") - c("radius")))
    steady = (c("_spread") / (c("radius") + 1e-9) <= radius_spread) & (F.coalesce("_normals", F.lit(0.0)) <= normal_spread)
    return found.select(*SEGMENT, "cx", "cy", "radius", F.when(steady, worst).otherwise(F.lit(float("inf"))).alias("arc_error"))


def _circle_centre(points: Column) -> Column:
    """Circle centre of a short array of points, or its mean when they lie on a line."""
    n = F.size(points)
    total = lambda f: F.aggregate(F.transform(points, f), F.lit(0.0), lambda t, v: t + v)
    mean = F.struct((total(lambda p: p["x"]) / n).alias("x"), (total(lambda p: p["y"]) / n).alias("y"))

    def solve(m: Column) -> Column:
        u, v = (lambda p: p["x"] - m["x"]), (lambda p: p["y"] - m["y"])
        sums = F.struct(
            total(lambda p: u(p) * u(p)).alias("uu"), total(lambda p: u(p) * v(p)).alias("uv"), total(lambda p: v(p) * v(p)).alias("vv"),
            (total(lambda p: u(p) * (u(p) * u(p) + v(p) * v(p))) / 2).alias("p"),
            (total(lambda p: v(p) * (u(p) * u(p) + v(p) * v(p))) / 2).alias("q"), m.alias("m"),
        )
        return F.transform(F.array(sums), lambda s: _solved(s))[0]

    def _solved(s: Column) -> Column:
        det = s["uu"] * s["vv"] - s["uv"] * s["uv"]
        # Points on a line up to rounding have no circle; their determinant is noise.
        ok = F.abs(det) > 1e-24 * (s["uu"] + s["vv"]) * (s["uu"] + s["vv"])
        return F.struct(
            (s["m"]["x"] + F.when(ok, F.try_divide(s["p"] * s["vv"] - s["q"] * s["uv"], det)).otherwise(0.0)).alias("x"),
            (s["m"]["y"] + F.when(ok, F.try_divide(s["q"] * s["uu"] - s["p"] * s["uv"], det)).otherwise(0.0)).alias("y"),
        )

    return F.transform(F.array(mean), solve)[0]


def arc_quality(
    segments: DataFrame, radius_rms: float = 0.02, drift: float = 1.0, span: float = 15.0, spans: Spans | None = None
) -> DataFrame:
    """Arc test of each segment with at least six points.

    Radius RMS, drift of the centres of sliding windows, covered angle, and
    whether left and right turns mix.
    """
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    c = F.col
    rows = segments.join(_circles(segments).filter(c("n") >= 6), SEGMENT).withColumn("p0", F.struct("x", "y"))
    for k in range(1, 5):
        rows = with_neighbours(rows, SEGMENT, ["idx"], [f"p{k - 1}"], spans, prev=None, next="_next")
        rows = rows.withColumn(f"p{k}", c(f"_next.p{k - 1}")).drop("_next")
    rows = with_neighbours(rows, SEGMENT, ["idx"], ["x", "y"], spans, next=None)
    gx, gy = c("x") - c("cx"), c("y") - c("cy")
    turn = F.atan2(gy, gx) - F.atan2(c("prev.y") - c("cy"), c("prev.x") - c("cx"))
    wrapped = F.pmod(turn + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)
    # A step of exactly half a turn keeps its sign.
    wrapped = F.when((wrapped == -math.pi) & (turn > 0), F.lit(math.pi)).otherwise(wrapped)
    size = F.least(F.lit(5), F.floor(c("n") / 2)).cast("int")
    window = F.filter(F.slice(F.array(*[c(f"p{k}") for k in range(5)]), F.lit(1), size), lambda p: p.isNotNull())
    full = F.size(window) == size
    bend = (c("p1.x") - c("x")) * (c("p2.y") - c("p1.y")) - (c("p1.y") - c("y")) * (c("p2.x") - c("p1.x"))
    rows = rows.select(
        *SEGMENT, "idx", "n", "cx", "cy", F.hypot(gx, gy).alias("d"), F.coalesce(wrapped, F.lit(0.0)).alias("_step"),
        F.when(full, _circle_centre(window)).alias("centre"), F.when(c("p2").isNotNull(), F.signum(bend)).alias("side"),
    )
    rows = with_running(rows, SEGMENT, ["idx"], {"angle": ("sum", c("_step"))}, spans)
    found = rows.groupBy(*SEGMENT, "n", "cx", "cy").agg(
        F.avg("d").alias("radius"), (F.stddev_pop("d") / (F.avg("d") + 1e-9)).alias("sigma_r"),
        F.count("centre").alias("_windows"), F.greatest(F.stddev_pop("centre.x"), F.stddev_pop("centre.y")).alias("_drift"),
        F.degrees(F.max("angle") - F.min("angle")).alias("angle_span"),
        F.avg(F.when(c("side") > 0, 1.0).when(c("side").isNotNull(), 0.0)).alias("_left"),
        F.avg(F.when(c("side") < 0, 1.0).when(c("side").isNotNull(), 0.0)).alias("_right"),
    )
    sigma_c = F.when(c("_windows") < 3, F.lit(0.0)).otherwise(c("_drift"))
    mixed = (c("_left") > 0.3) & (c("_right") > 0.3)
    good = (c("sigma_r") <= radius_rms) & (c("sigma_c") <= drift) & (c("angle_span") >= span) & ~F.coalesce(mixed, F.lit(False))
    return found.withColumn("sigma_c", sigma_c).select(
        *SEGMENT, "n", "cx", "cy", "radius", "sigma_r", "sigma_c", "angle_span", good.alias("is_arc")
    )


def classify_segments(segments: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Line, arc or spline for each segment; lines and arcs that are too small are dropped."""
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    c = F.col
    rows = line_fit_chord(segments).filter(c("n") >= 2).join(circle_fit(segments, spans=spans), SEGMENT, "left")
    line, arc = c("line_error") < LINE_LIMIT, F.coalesce(c("arc_error") < ARC_LIMIT, F.lit(False))
    kind = F.when(line, "line").when(arc, "arc").otherwise("spline")
    small = (line & (c("chord") < MIN_CHORD)) | (~line & arc & (c("radius") < MIN_RADIUS))
    shape = lambda name: F.when(~line & arc, c(name)).alias(name)
    return rows.filter(~small).select(*SEGMENT, kind.alias("type"), "line_error", "chord", shape("cx"), shape("cy"), shape("radius"))


def drop_short_segments(segments: DataFrame, min_length: float = MIN_LENGTH, spans: Spans | None = None) -> DataFrame:
    """Length of each segment, kept from ``min_length`` on."""
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    rows = with_neighbours(segments, SEGMENT, ["idx"], ["x", "y"], spans, prev=None)
    step = F.hypot(F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"))
    sizes = rows.groupBy(*SEGMENT).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"))
    return sizes.filter(F.col("length") >= min_length)


def segment_decision(
    segments: DataFrame, radius_rms: float = 0.02, span: float = 20.0, min_points: int = 8, spans: Spans | None = None
) -> DataFrame:
    """Line first, then an arc that passes all tests, else a spline."""
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    lines = line_fit_pca(segments, spans=spans).select(*SEGMENT, "n", "is_line")
    arcs = arc_quality(segments, radius_rms, 1.0, span, spans).drop("n")
    c = F.col
    hard = c("is_arc") & (c("sigma_r") < radius_rms) & (c("angle_span") > span) & (c("n") >= min_points)
    return lines.join(arcs, SEGMENT, "left").select(
        *SEGMENT, F.when(c("is_line"), "line").when(F.coalesce(hard, F.lit(False)), "arc").otherwise("spline").alias("decision")
    )


# ---- merging ---------------------------------------------------------------

OUT = "contour_id long, segment long, type string, idx long, x double, y double, error double"


def _pca_line(points: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Largest distance to the principal axis and the ends of its used stretch."""
    mean = points.mean(axis=0)
    axis = np.linalg.svd(points - mean, full_matrices=False)[2][0]
    along = (points - mean) @ axis
    away = np.linalg.norm(points - mean - np.outer(along, axis), axis=1)
    return float(away.max()), mean + axis * along.min(), mean + axis * along.max()


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    """Undirected angle in degrees; zero-length vectors count as parallel."""
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    if size <= 1e-12:
        return 0.0
    return float(np.degrees(np.arccos(min(1.0, abs(float(a @ b)) / size))))


def _least_squares_circle(points: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Largest circle error (infinite unless steady), centre and radius."""
    mean = points.mean(axis=0)
    u, v = (points - mean).T
    square = u * u + v * v
    matrix = np.array([[u @ u, u @ v], [u @ v, v @ v]])
    if abs(np.linalg.det(matrix)) <= 1e-12 * max(matrix[0, 0] * matrix[1, 1], 1e-300):
        return math.inf, mean, 0.0
    centre = mean + np.linalg.solve(matrix, np.array([u @ square, v @ square]) / 2)
    reach = np.linalg.norm(points - centre, axis=1)
    radius = float(np.sqrt((reach**2).mean()))
    normals = (points - centre) / np.maximum(reach, 1e-9)[:, None]
    turns = np.arccos(np.clip((normals[:-1] * normals[1:]).sum(axis=1), -1.0, 1.0))
    if reach.std() / (radius + 1e-9) > 0.05 or turns.std() > 0.1:
        return math.inf, centre, radius
    return float(np.abs(reach - radius).max()), centre, radius


def _runs(segments: DataFrame, reach: float, same_type: bool, spans: Spans) -> DataFrame:
    """Number the runs of segments that might merge; others can be treated apart.

    Merging only joins neighbours whose ends lie within ``reach``, and with
    ``same_type`` only equal types, so every other border is final.
    """
    spot = F.struct("x", "y")
    heads = segments.groupBy(*SEGMENT).agg(
        F.min_by(spot, "idx").alias("a"), F.max_by(spot, "idx").alias("b"), F.first("type").alias("_type")
    )
    rows = with_neighbours(heads, KEY, ["segment"], ["b", "_type"], ensure_spans(heads, KEY, "segment", spans), next=None)
    gap = F.hypot(F.col("a.x") - F.col("prev.b.x"), F.col("a.y") - F.col("prev.b.y"))
    apart = F.col("prev").isNull() | (gap > reach)
    if same_type:
        apart = apart | (F.col("_type") != F.col("prev._type"))
    marked = with_islands(rows, KEY, ["segment"], apart, ensure_spans(heads, KEY, "segment", spans), "run")
    return segments.join(marked.select(*SEGMENT, "run"), SEGMENT)


@dataclass(eq=False)
class Piece:
    """A segment in a chain of neighbours, with the model of its last fit."""

    segment: int
    kind: str
    points: np.ndarray
    idx: np.ndarray
    error: float
    axis: tuple[np.ndarray, np.ndarray] | None = None  # ends of a fitted line
    circle: tuple[np.ndarray, float] | None = None  # centre and radius of a fitted arc
    before: Piece | None = None
    after: Piece | None = None
    gone: bool = False

    @property
    def length(self) -> float:
        return float(np.linalg.norm(np.diff(self.points, axis=0), axis=1).sum())

    def with_next(self, kind: str, error: float, **model) -> Piece:
        """This piece and the one after it as a new piece; the shared point counts once."""
        return Piece(
            self.segment, kind, np.vstack([self.points, self.after.points[1:]]), np.concatenate([self.idx, self.after.idx[1:]]), error, **model)


class Chain:
    """Pieces of one run as a linked list, so a merge touches its two neighbours only."""

    def __init__(self, group: Columns) -> None:
        self.contour = group["contour_id"][0]
        cuts = np.flatnonzero(np.diff(group["segment"])) + 1
        points = np.column_stack([group["x"], group["y"]])
        errors = np.nan_to_num(group["error"].astype(float)) if "error" in group else np.zeros(len(points))
        columns = zip(*[np.split(c, cuts) for c in (group["segment"], group["type"], points, group["idx"], errors)])
        pieces = [Piece(s[0], k[0], p, i, float(e[0])) for s, k, p, i, e in columns]
        for left, right in zip(pieces, pieces[1:]):
            left.after, right.before = right, left
        self.head, self.size = pieces[0], len(pieces)

    def __iter__(self):
        piece = self.head
        while piece is not None:
            yield piece
            piece = piece.after

    def put(self, left: Piece, made: Piece) -> Piece:
        """Replace ``left`` and its follower by ``made``."""
        right = left.after
        made.before, made.after = left.before, right.after
        left.gone = right.gone = True
        if made.before is None:
            self.head = made
        else:
            made.before.after = made
        if made.after is not None:
            made.after.before = made
        self.size -= 1
        return made

    def merge_best(self, offer, until: int = 1) -> None:
        """Take the offer of lowest price, the first of equals, until none or ``until`` pieces are left.

        ``offer(piece)`` gives the price and the merged piece for a piece and
        its follower, or nothing. Offers wait in a heap; those of pieces that
        are gone are passed over.
        """
        heap: list = []
        count = itertools.count()

        def ask(piece: Piece | None) -> None:
            if piece is not None and piece.after is not None and (made := offer(piece)):
                heapq.heappush(heap, (made[0], piece.idx[0], next(count), piece, piece.after, made[1]))

        for piece in self:
            ask(piece)
        while heap and self.size > until:
            *_, left, right, made = heapq.heappop(heap)
            if not (left.gone or right.gone):
                self.put(left, made)
                ask(made.before)
                ask(made)

    def columns(self) -> Columns:
        pieces = list(self)
        sizes = [len(p.idx) for p in pieces]
        points = np.vstack([p.points for p in pieces])
        return {
            "contour_id": self.contour, "segment": np.repeat([p.segment for p in pieces], sizes),
            "type": np.repeat(np.array([p.kind for p in pieces], dtype=object), sizes),
            "idx": np.concatenate([p.idx for p in pieces]), "x": points[:, 0], "y": points[:, 1],
            "error": np.repeat([p.error for p in pieces], sizes),
        }


def _line_of(points: np.ndarray) -> dict:
    error, start, end = _pca_line(points)
    return {"error": error, "axis": (start, end)}


def _like_lines(a: Piece, b: Piece, turn: float, worst: float) -> Piece | None:
    """Two chords that point the same way and whose joint line fits."""
    chords = [p.points[-1] - p.points[0] for p in (a, b)]
    if min(np.linalg.norm(c) for c in chords) <= 1e-8 or _angle(*chords) > turn:
        return None
    joint = a.with_next("line", 0.0)
    joint.error = _pca_line(joint.points)[0]
    return joint if joint.error <= worst else None


def _like_arcs(a: Piece, b: Piece, shift: float, ratio: float, worst: float) -> Piece | None:
    """Two arcs of nearly one circle that also fit one circle together."""
    (_, ca, ra), (_, cb, rb) = (_least_squares_circle(p.points) for p in (a, b))
    if np.linalg.norm(ca - cb) > shift or abs(ra - rb) / max(ra, rb, 1e-9) > ratio:
        return None
    joint = a.with_next("arc", 0.0)
    joint.error = _least_squares_circle(joint.points)[0]
    return joint if joint.error <= worst else None


# Largest turn (degrees), circle shift and radius ratio, and error of a merged pair.
ADJACENT = {
    "line": lambda a, b: _like_lines(a, b, 5.0, 3.0),
    "arc": lambda a, b: _like_arcs(a, b, 4.0, 0.05, 3.0),
    "spline": lambda a, b: a.with_next("spline", 0.0),
}


def merge_adjacent(segments: DataFrame, spans: Spans | None = None) -> DataFrame:
    """One pass from left to right that joins pairs of like neighbours.

    ``segments(contour_id, segment, type, idx, x, y)``. Lines within 5 degrees,
    arcs on the same circle, splines always, when the ends lie within 3. Runs
    of joinable segments are independent and folded apart.
    """
    spans = ensure_spans(segments, SEGMENT, "idx", spans)

    def one_pass(group: Columns) -> Columns:
        chain = Chain(group)
        piece = chain.head
        while piece is not None and piece.after is not None:
            right = piece.after
            like = piece.kind == right.kind and min(len(piece.points), len(right.points)) >= 2
            made = ADJACENT[piece.kind](piece, right) if like and piece.kind in ADJACENT else None
            piece = (chain.put(piece, made) if made else piece).after
        return chain.columns()

    return fold_groups(_runs(segments, 3.0, True, spans), [*KEY, "run"], ["segment", "idx"], one_pass, OUT)


@dataclass(frozen=True)
class MergeRule:
    """When two neighbours become one, and what they become.

    Fixed rule: equal lines within a turn and equal arcs within a reach may
    merge when the error grows by ``slack`` at most; a line and another kind
    become a line when that fits within 1; all other pairs keep the first kind
    and the worse error.
    """

    angle: float
    reach: float
    slack: float

    def __call__(self, a: Piece) -> Piece | None:
        b = a.after
        if min(len(a.points), len(b.points)) < 2 or np.linalg.norm(a.points[-1] - b.points[0]) > self.reach:
            return None
        kinds, limit = {a.kind, b.kind}, max(a.error, b.error)
        if kinds == {"line"}:
            return self._lines(a, b, limit * self.slack)
        if kinds == {"arc"}:
            return self._arcs(a, b, limit * self.slack)
        if "line" in kinds:
            joint = a.with_next("line", 0.0)
            model = _line_of(joint.points)
            if model["error"] < 1.0:
                return replace(joint, **model)
        return a.with_next(a.kind, limit)

    def _lines(self, a: Piece, b: Piece, limit: float) -> Piece | None:
        joint = a.with_next("line", 0.0)
        # A line never fitted lends the outer ends of the pair.
        outer = (joint.points[0], joint.points[-1])
        (a0, a1), (b0, b1) = a.axis or outer, b.axis or outer
        model = _line_of(joint.points)
        return replace(joint, **model) if _angle(a1 - a0, b1 - b0) <= self.angle and model["error"] <= limit else None

    def _arcs(self, a: Piece, b: Piece, limit: float) -> Piece | None:
        (ca, ra), (cb, rb) = (p.circle or _least_squares_circle(p.points)[1:] for p in (a, b))
        if np.linalg.norm(ca - cb) >= 2 * self.reach or abs(ra - rb) >= self.reach:
            return None
        centre, radius = (ca + cb) / 2, (ra + rb) / 2
        joint = a.with_next("arc", 0.0, circle=(centre, radius))
        joint.error = float(np.abs(np.linalg.norm(joint.points - centre, axis=1) - radius).max())
        return joint if joint.error <= limit else None


def merge_greedy(
    segments: DataFrame, cap: int | None = None, angle: float = 15.0, reach: float = 5.0, min_length: float = 20.0,
    slack: float = 1.5, spans: Spans | None = None,
) -> DataFrame:
    """Merge short segments first, then the cheapest neighbours until none is left.

    ``segments(contour_id, segment, type, idx, x, y, error)``. Borders wider
    than ``reach`` never merge, so the runs between them are folded apart. Only
    outlines that still exceed ``cap`` are gathered once more and forced down.
    """
    spans = ensure_spans(segments, SEGMENT, "idx", spans)
    rule = MergeRule(angle, reach, slack)

    def run(group: Columns) -> Columns:
        chain = Chain(group)
        piece = chain.head
        while piece is not None:
            # A short piece goes to the one after it, else to the one before.
            if piece.length < min_length:
                for left in (piece, piece.before):
                    made = rule(left) if left is not None and left.after is not None else None
                    if made:
                        piece = chain.put(left, made)
                        break
            piece = piece.after

        def cheapest(left: Piece) -> tuple[float, Piece] | None:
            made = rule(left)
            return (made.error, made) if made else None

        chain.merge_best(cheapest)
        return chain.columns()

    merged = fold_groups(_runs(segments, reach, False, spans), [*KEY, "run"], ["segment", "idx"], run, OUT)
    if cap is None:
        return merged

    def force(group: Columns) -> Columns:
        def any_pair(left: Piece) -> tuple[float, Piece]:
            worse = max(left.error, left.after.error)
            return worse, rule(left) or left.with_next("spline", worse)

        chain = Chain(group)
        chain.merge_best(any_pair, cap)
        return chain.columns()

    counts = merged.groupBy(*KEY).agg(F.count_distinct("segment").alias("_parts"))
    sized = merged.join(counts, KEY)
    forced = fold_groups(sized.filter(F.col("_parts") > cap).drop("_parts"), KEY, ["segment", "idx"], force, OUT)
    return sized.filter(F.col("_parts") <= cap).drop("_parts").unionByName(forced)
