"""Conservative repair of outlines: ``points(contour_id, idx, x, y[, z])``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepfield.operators.contours import KEY
from sweepfield.operators.validate import CLOSURE_TOL, DUPLICATE_TOL, MIN_EDGE, PLANARITY_TOL
from sweepfield.plans.blocks import fold_in_blocks, in_blocks
from sweepfield.plans.folds import Columns
from sweepfield.plans.ordered import Spans, ensure_spans, with_group, with_islands, with_neighbours, with_position
from sweepfield.session import shared_folder

PLANARITY_REPAIR_TOL = 1e-6  # fixed value: larger deviations are left alone


def _thin(points: DataFrame, limit: float, axes: list[str], keep_equal: bool, spans: Spans) -> DataFrame:
    """Drop points too close to the last kept one.

    A dropped point lies within ``limit`` of the last kept point, so a step
    above twice the limit always reaches a kept point. The order is cut there;
    the runs between are folded, long ones in blocks that carry the last kept
    point.
    """
    rows = with_neighbours(points, KEY, ["idx"], axes, spans, next=None)
    step = F.sqrt(sum(((F.col(a) - F.col(f"prev.{a}")) * (F.col(a) - F.col(f"prev.{a}")) for a in axes), F.lit(0.0)))
    fresh = F.coalesce(step > 2 * limit, F.lit(True))
    runs = with_islands(rows, KEY, ["idx"], fresh, spans, "run").select(*points.columns, "run")
    alone = with_group(runs, [*KEY, "run"], {"_size": F.count(F.lit(1))}, spans)
    crowded = in_blocks(alone.filter("_size > 1").drop("_size"), [*KEY, "run"], ["idx"], spans)

    names = points.columns

    def walk(group: Columns):
        """Rows kept, and where the last kept point is."""
        where = np.column_stack([group[a].astype(float) for a in axes])
        last, kept = (np.array([group[f"held_{a}"][0] for a in axes]) if group["held"][0] else None), []
        for i, spot in enumerate(where):
            far = None if last is None else np.sqrt(((spot - last) ** 2).sum())
            if far is None or (far >= limit if keep_equal else far > limit):
                kept.append(i)
                last = spot
        return kept, last

    def leave(group: Columns) -> Columns:
        _, last = walk(group)
        return {"held": np.array([True]), **{f"held_{a}": np.array([v]) for a, v in zip(axes, last)}}

    def close(group: Columns) -> Columns | None:
        kept, _ = walk(group)
        return {name: group[name][kept] for name in names} if kept else None

    state = {"held": ("boolean", False), **{f"held_{a}": ("double", 0.0) for a in axes}}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    thinned = fold_in_blocks(crowded, [*KEY, "run"], ["idx"], leave, close, state, schema)
    return alone.filter("_size = 1").select(*points.columns).unionByName(thinned)


def drop_duplicates_kept(
    points: DataFrame, tol: float = 1e-7, spans: Spans | None = None, close: bool = True
) -> DataFrame:
    """Keep points further than ``tol`` from the last kept one; drop a last point equal to the first."""
    spans = ensure_spans(points, KEY, "idx", spans)
    axes = [a for a in ("x", "y", "z") if a in points.columns]
    kept = _thin(points, tol, axes, False, spans)
    if not close:
        return kept
    spot = F.struct("idx", *axes)
    ends = kept.groupBy(*KEY).agg(F.min_by(spot, "idx").alias("a"), F.max_by(spot, "idx").alias("b"), F.count(F.lit(1)).alias("_n"))
    gap = F.sqrt(sum(((F.col(f"a.{x}") - F.col(f"b.{x}")) * (F.col(f"a.{x}") - F.col(f"b.{x}")) for x in axes), F.lit(0.0)))
    doubled = ends.filter((F.col("_n") > 1) & (gap <= tol)).select(*KEY, F.col("b.idx").alias("idx"))
    return kept.join(doubled, [*KEY, "idx"], "left_anti")


def repair_points(points: DataFrame, loops: DataFrame, spans: Spans | None = None) -> tuple[DataFrame, DataFrame]:
    """Repaired points and one log row per change.

    Steps in order: duplicates, tiny edges (from four points on), flattening z
    to its mean, closing. ``loops(contour_id, closed, explicit_closure)`` says
    whether an outline is closed and whether its last point repeats the first.
    """
    spans = ensure_spans(points, KEY, "idx", spans)
    rows = points if "z" in points.columns else points.withColumn("z", F.lit(0.0))
    rows = rows.select(*KEY, "idx", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    count = lambda df, name: df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    start = count(rows, "n0")
    # Each thinning is used several times and made once.
    shared_folder(points.sparkSession)
    unique = _thin(rows, DUPLICATE_TOL, ["x", "y", "z"], False, spans).checkpoint()
    second = count(unique, "n1")
    small = second.filter("n1 <= 3").select(*KEY)
    thin = _thin(unique.join(small, KEY, "left_anti"), MIN_EDGE, ["x", "y"], True, spans)
    left = thin.unionByName(unique.join(small, KEY, "left_semi")).checkpoint()
    spot = F.struct("idx", "x", "y", "z")
    facts = left.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n2"), F.avg("z").alias("mean_z"), F.min("z").alias("_z0"), F.max("z").alias("_z1"),
        F.min_by(spot, "idx").alias("a"), F.max_by(spot, "idx").alias("b"),
    )
    off = F.greatest(F.col("_z1") - F.col("mean_z"), F.col("mean_z") - F.col("_z0"))
    gap = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    shaped = (F.col("n2") >= 3) & F.col("closed")
    plan = facts.join(loops.select(*KEY, "closed", "explicit_closure"), KEY).select(
        *KEY, "n2", "mean_z", "a", "b", "closed",
        ((F.col("n2") >= 3) & (off > PLANARITY_TOL) & (off < PLANARITY_REPAIR_TOL)).alias("flatten"),
        (shaped & (gap > CLOSURE_TOL) & ~F.col("explicit_closure")).alias("append"),
        (shaped & (gap > CLOSURE_TOL) & F.col("explicit_closure")).alias("snap"),
        (shaped & (gap <= CLOSURE_TOL)).alias("weld"),
    )
    z = lambda v: F.when(F.col("flatten"), F.col("mean_z")).otherwise(v)
    joined = left.join(plan, KEY)
    last = (F.col("snap") | F.col("weld")) & (F.col("idx") == F.col("b.idx"))
    moved = joined.select(
        *KEY, "idx", F.when(last, F.col("a.x")).otherwise(F.col("x")).alias("x"), F.when(last, F.col("a.y")).otherwise(F.col("y")).alias("y"),
        z(F.when(last, F.col("a.z")).otherwise(F.col("z"))).alias("z"),
    )
    extra = plan.filter("append").select(*KEY, (F.col("b.idx") + 1).alias("idx"), "a.x", "a.y", z(F.col("a.z")).alias("z"))
    whole = with_position(moved.unionByName(extra), KEY, ["idx"], spans, "_p")
    repaired = whole.select(*KEY, (F.col("_p") - 1).alias("idx"), "x", "y", "z")
    entry = lambda hit, step, text, amount: F.when(hit, F.struct(F.lit(step).alias("step"), F.lit(text).alias("operation"), amount.cast("double").alias("amount")))
    log = start.join(second, KEY).join(plan, KEY).select(*KEY, F.inline(F.array_compact(F.array(
        entry(F.col("n0") > F.col("n1"), 1, "remove consecutive duplicate points", F.col("n0") - F.col("n1")),
        entry(F.col("n1") > F.col("n2"), 2, "remove degenerate tiny-edge points", F.col("n1") - F.col("n2")),
        entry(F.col("flatten"), 3, "flatten z to mean plane", F.col("mean_z")),
        entry(F.col("snap"), 4, "snap explicit closure point to first", gap),
        entry(F.col("append"), 4, "append explicit closure point", gap),
    ))))
    return repaired, log
