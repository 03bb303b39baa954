"""Evaluation of fitted curves against their originals.

Point tables ``a`` and ``b`` share ``pair_id`` and hold ``idx, x, y`` each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepfield.functions.numeric import col
from sweepfield.operators import contours
from sweepfield.plans.grid import SMALL, around
from sweepfield.plans.ordered import Spans, ensure_spans, with_group, with_running

PAIR = ["pair_id"]
WHOLE = 60  # level of one cell for everything: 2**60 units wide


def _cell(axis: str, level: Column) -> Column:
    return F.floor(F.col(axis) / F.pow(F.lit(2.0), level)).cast("long")


def _at_level(points: DataFrame) -> DataFrame:
    level = F.col("level")
    return points.select("*", _cell("x", level).alias("cell_x"), _cell("y", level).alias("cell_y"))


def nearest_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance from every point of ``a`` to its nearest point of ``b``.

    When every curve of ``b`` is small, points are compared directly, at most 64
    per point. Otherwise a pyramid of occupied
    cells gives each point a distance it cannot exceed, within a small factor
    of the answer; then only points of ``b`` in the cells of that size around
    it are compared. No step pairs up whole curves.
    """
    counts = b.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    if counts.filter(F.col("n") > SMALL).isEmpty():
        other = b.select(*PAIR, F.col("x").alias("bx"), F.col("y").alias("by"))
        gap = F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))
        return a.select(*PAIR, "idx", "x", "y").join(other, PAIR).groupBy(*PAIR, "idx").agg(F.min(gap).alias("distance"))
    hull = lambda p: [F.min("x").alias(f"{p}x0"), F.max("x").alias(f"{p}x1"), F.min("y").alias(f"{p}y0"), F.max("y").alias(f"{p}y1")]
    sizes = b.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), *hull("b")).join(a.groupBy(*PAIR).agg(*hull("a")), PAIR)
    extent = F.greatest(
        F.greatest("ax1", "bx1") - F.least("ax0", "bx0"), F.greatest("ay1", "by1") - F.least("ay0", "by0"), F.lit(1e-9)
    )
    top = F.ceil(F.log2(extent)).cast("int")
    sizes = sizes.select(*PAIR, "n", top.alias("top"), (top - F.ceil(F.log2("n")).cast("int") - 1).alias("bottom"))
    large = sizes.filter(F.col("n") > SMALL)

    # Pyramid: one sample point per occupied cell and level.
    levels = large.select(*PAIR, F.explode(F.sequence("bottom", "top")).alias("level"))
    occupied = _at_level(b.join(levels, PAIR)).groupBy(*PAIR, "level", "cell_x", "cell_y").agg(
        F.min(F.struct("x", "y")).alias("sample")
    )
    asked = _at_level(a.select(*PAIR, "idx", "x", "y").join(levels, PAIR))
    seen = asked.join(around(occupied).drop("_home"), [*PAIR, "level", "cell_x", "cell_y"])
    bounds = seen.groupBy(*PAIR, "idx").agg(
        F.min(F.hypot(F.col("sample.x") - F.col("x"), F.col("sample.y") - F.col("y"))).alias("bound")
    )

    own = F.ceil(F.log2(F.greatest("bound", F.lit(1e-12))) + 1e-9).cast("int")
    placed = a.select(*PAIR, "idx", "x", "y").join(sizes.select(*PAIR, "n"), PAIR).join(bounds, [*PAIR, "idx"], "left").select(
        *PAIR, "idx", "x", "y", F.when(F.col("n") <= SMALL, F.lit(WHOLE)).otherwise(own).alias("level")
    )
    used = placed.select(*PAIR, "level").distinct()
    spread = around(_at_level(b.select(*PAIR, "x", "y").join(used, PAIR)).withColumnsRenamed({"x": "bx", "y": "by"})).drop("_home")
    met = _at_level(placed).join(spread, [*PAIR, "level", "cell_x", "cell_y"])
    return met.groupBy(*PAIR, "idx").agg(F.min(F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))).alias("distance"))


def _directed(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
    d = F.col("distance")
    return nearest_distances(a, b).groupBy(*PAIR).agg(
        F.avg(d).alias(f"{side}_mean"), F.avg(d * d).alias(f"{side}_square"), F.max(d).alias(f"{side}_max")
    )


def fit_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """MSE, RMSE, MAE (means of both directions) and Hausdorff distance."""
    both = _directed(a, b, "a").join(_directed(b, a, "b"), PAIR)
    mse = (F.col("a_square") + F.col("b_square")) / 2
    return both.select(
        *PAIR, mse.alias("mse"), F.sqrt(mse).alias("rmse"), ((F.col("a_mean") + F.col("b_mean")) / 2).alias("mae"),
        F.greatest("a_max", "b_max").alias("hausdorff"),
    )


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Larger of both directed maxima."""
    return fit_errors(a, b).select(*PAIR, "hausdorff")


def _as_contours(points: DataFrame) -> DataFrame:
    return points.select(F.col("pair_id").alias("contour_id"), "idx", "x", "y")


def _measures(points: DataFrame, prefix: str, spans: Spans | None) -> DataFrame:
    rows = contours.linked(_as_contours(points), spans, cyclic=True)
    step = F.hypot(F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"))
    return rows.groupBy("contour_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), F.abs(contours.shoelace()).alias(f"{prefix}_area"), F.sum(step).alias(f"{prefix}_perimeter")
    ).withColumnRenamed("contour_id", "pair_id")


def area_perimeter_error(a: DataFrame, b: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Absolute and relative errors of area and closed perimeter; infinite under three points."""
    both = _measures(a, "a", spans).join(_measures(b, "b", spans), PAIR)
    usable = (F.col("a_n") >= 3) & (F.col("b_n") >= 3)
    out = []
    for name in ("area", "perimeter"):
        gap = F.when(usable, F.abs(F.col(f"a_{name}") - F.col(f"b_{name}"))).otherwise(F.lit(float("inf")))
        out += [gap.alias(f"{name}_error"), (gap / F.greatest(F.col(f"a_{name}"), F.lit(1.0))).alias(f"{name}_relative")]
    return both.select(*PAIR, *out)


def hu_invariants(points: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Signed logarithms of the seven moment invariants of each polygon.

    Raw moments are Green sums over the edges, so one aggregate per outline
    suffices; the invariants are plain expressions of those.
    """
    rows = contours.linked(_as_contours(points), spans, cyclic=True)
    x0, y0, x1, y1 = F.col("prev.x"), F.col("prev.y"), F.col("x"), F.col("y")
    a = x0 * y1 - x1 * y0
    raw = rows.groupBy("contour_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(a) / 2).alias("m00"), (F.sum(a * (x0 + x1)) / 6).alias("m10"), (F.sum(a * (y0 + y1)) / 6).alias("m01"),
        (F.sum(a * (x0 * x0 + x0 * x1 + x1 * x1)) / 12).alias("m20"), (F.sum(a * (y0 * y0 + y0 * y1 + y1 * y1)) / 12).alias("m02"),
        (F.sum(a * (x0 * (2 * y0 + y1) + x1 * (y0 + 2 * y1))) / 24).alias("m11"),
        (F.sum(a * (x0 + x1) * (x0 * x0 + x1 * x1)) / 20).alias("m30"), (F.sum(a * (y0 + y1) * (y0 * y0 + y1 * y1)) / 20).alias("m03"),
        (F.sum(a * (x0 * x0 * (3 * y0 + y1) + 2 * x0 * x1 * (y0 + y1) + x1 * x1 * (y0 + 3 * y1))) / 60).alias("m21"),
        (F.sum(a * (y0 * y0 * (3 * x0 + x1) + 2 * y0 * y1 * (x0 + x1) + y1 * y1 * (x0 + 3 * x1))) / 60).alias("m12"),
    )
    c = F.col
    sign = F.when(c("m00") < 0, -1.0).otherwise(1.0)
    names = ["m00", "m10", "m01", "m20", "m11", "m02", "m30", "m21", "m12", "m03"]
    flipped = raw.select("contour_id", "n", *[(c(m) * sign).alias(m) for m in names])
    centred = flipped.withColumn("cx", F.try_divide("m10", "m00")).withColumn("cy", F.try_divide("m01", "m00")).select(
        "*", (c("m20") - c("m10") * c("cx")).alias("u20"), (c("m11") - c("m10") * c("cy")).alias("u11"), (c("m02") - c("m01") * c("cy")).alias("u02")
    ).select(
        "*", (c("m30") - c("cx") * (3 * c("u20") + c("cx") * c("m10"))).alias("u30"),
        (c("m21") - c("cx") * (2 * c("u11") + c("cx") * c("m01")) - c("cy") * c("u20")).alias("u21"),
        (c("m12") - c("cy") * (2 * c("u11") + c("cy") * c("m10")) - c("cx") * c("u02")).alias("u12"),
        (c("m03") - c("cy") * (3 * c("u02") + c("cy") * c("m01"))).alias("u03"),
    )
    second = F.try_divide(F.lit(1.0), c("m00") * c("m00"))
    third = F.try_divide(second, F.sqrt(F.abs("m00")))
    v = centred.select(
        "contour_id", "n", "m00", *[(c(f"u{k}") * second).alias(f"v{k}") for k in ("20", "11", "02")],
        *[(c(f"u{k}") * third).alias(f"v{k}") for k in ("30", "21", "12", "03")],
    )
    p, q, d = c("v30") + c("v12"), c("v21") + c("v03"), c("v20") - c("v02")
    r, s = c("v30") - 3 * c("v12"), 3 * c("v21") - c("v03")
    hu = [
        c("v20") + c("v02"), d * d + 4 * c("v11") * c("v11"), r * r + s * s, p * p + q * q,
        r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q), d * (p * p - q * q) + 4 * c("v11") * p * q,
        s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q),
    ]
    logs = F.array(*[-F.signum(h) * F.log10(F.abs(h) + 1e-10) for h in hu])
    return v.select(F.col("contour_id").alias("pair_id"), F.when((c("n") >= 3) & (c("m00") != 0), logs).alias("hu"))


def shape_similarity(a: DataFrame, b: DataFrame, spans: Spans | None = None) -> DataFrame:
    """``1/(1+distance)`` of the log invariants; 0 when either is unusable."""
    both = hu_invariants(a, spans).join(hu_invariants(b, spans).withColumnRenamed("hu", "hu_b"), PAIR)
    squares = F.transform(F.arrays_zip("hu", "hu_b"), lambda z: (z["hu"] - z["hu_b"]) * (z["hu"] - z["hu_b"]))
    gap = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, v: t + v))
    return both.select(*PAIR, F.coalesce(1.0 / (1.0 + gap), F.lit(0.0)).alias("similarity"))


def extrema(points: DataFrame) -> DataFrame:
    """Leftmost, rightmost, lowest-y and highest-y point of each curve; the first on ties."""
    spot = F.struct("x", "y")
    first = lambda axis: F.min_by(spot, F.struct(F.col(axis), F.col("idx")))
    last = lambda axis: F.max_by(spot, F.struct(F.col(axis), -F.col("idx")))
    return points.groupBy(*PAIR).agg(F.array(first("x"), last("x"), first("y"), last("y")).alias("extrema"))


def keypoint_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance of each extreme point of ``a`` to the nearest of ``b``: mean and maximum."""
    both = extrema(a).join(extrema(b).withColumnRenamed("extrema", "other"), PAIR)
    nearest = F.transform("extrema", lambda p: F.array_min(F.transform("other", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    rows = both.select(*PAIR, nearest.alias("d"))
    return rows.select(
        *PAIR, (F.aggregate("d", F.lit(0.0), lambda t, v: t + v) / F.size("d")).alias("mean_error"), F.array_max("d").alias("max_error")
    )


def _topology(points: DataFrame, prefix: str, spans: Spans | None, crossings: bool) -> DataFrame:
    shaped = _as_contours(points)
    rows = contours.linked(shaped, spans, cyclic=True)
    step = F.hypot(F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y"))
    close = lambda axis: F.abs(F.col(f"next.{axis}") - F.col(axis)) <= 1.0 + 1e-5 * F.abs(F.col(axis))
    found = rows.groupBy("contour_id").agg(
        F.count(F.lit(1)).alias("_n"), contours.shoelace().alias("_area"),
        F.max(F.when(~F.col("is_last"), step)).alias("_gap"), F.bool_or(F.col("is_last") & close("x") & close("y")).alias("_close"),
    ).select(
        "contour_id", (F.col("_close") & (F.col("_n") >= 3)).alias(f"{prefix}_closed"), F.signum("_area").alias(f"{prefix}_turn"),
        F.coalesce(F.col("_gap") < 10, F.lit(False)).alias(f"{prefix}_connected"), "_n", "_close",
    )
    if crossings:
        tagged = shaped.join(found.select("contour_id", "_n", "_close"), "contour_id")
        rings = tagged.filter(F.col("_close") & (F.col("idx") < F.col("_n") - 1)).select(*shaped.columns)
        lines = tagged.filter(~F.col("_close")).select(*shaped.columns)
        crossed = contours.self_intersections(rings, "ring", spans).unionByName(contours.self_intersections(lines, "open", spans))
        found = found.join(crossed, "contour_id", "left").withColumn(
            f"{prefix}_crossed", F.coalesce((F.col("crossings") > 0) & (F.col("_n") >= 4), F.lit(False))
        ).drop("crossings")
    return found.drop("_n", "_close").withColumnRenamed("contour_id", "pair_id")


def topology_consistency(a: DataFrame, b: DataFrame, spans: Spans | None = None) -> DataFrame:
    """Whether the fitted curve ``b`` keeps closure and orientation, is connected and does not cross itself."""
    spans = ensure_spans(_as_contours(a), ["contour_id"], "idx", spans)
    both = _topology(a, "a", spans, False).join(_topology(b, "b", spans, True), PAIR)
    return both.select(
        *PAIR, (F.col("a_closed") == F.col("b_closed")).alias("closed_consistent"), F.col("b_closed").alias("closed"),
        F.col("b_connected").alias("connected"), F.col("b_crossed").alias("self_crossing"),
        (F.col("a_turn") == F.col("b_turn")).alias("orientation_consistent"),
    )


def primitive_mix(primitives: DataFrame, key: str = "design_id") -> DataFrame:
    """Length share of line, arc and spline; mean and largest error: ``primitives(…, type, length, error)``."""
    total = F.sum("length")
    share = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("length"))) / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return primitives.groupBy(key).agg(
        F.count(F.lit(1)).alias("primitive_count"), share("line").alias("line_ratio"), share("arc").alias("arc_ratio"),
        share("bspline").alias("spline_ratio"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error"),
    )


def overall_score(
    rmse: Column, closed_ok: Column, connected: Column, crossing: Column, oriented: Column, primitive_error: Column, regularity: Column
) -> dict[str, Column]:
    """Four scores out of 100 and their weighted sum (0.4, 0.3, 0.2, 0.1)."""
    yes = lambda flag, default: F.coalesce(flag, F.lit(default))
    geometric = F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.least(rmse * 10, F.lit(100.0))), F.lit(100.0))
    topology = F.greatest(
        F.lit(0.0),
        F.lit(100.0) - F.when(yes(closed_ok, True), 0.0).otherwise(20.0) - F.when(yes(connected, True), 0.0).otherwise(30.0)
        - F.when(yes(crossing, False), 25.0).otherwise(0.0) - F.when(yes(oriented, True), 0.0).otherwise(10.0),
    )
    semantic = F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.least(primitive_error * 20, F.lit(100.0))), F.lit(100.0))
    engineering = F.coalesce(regularity, F.lit(50.0))
    return {
        "geometric": geometric, "topology": topology, "semantic": semantic, "engineering": engineering,
        "overall": 0.4 * geometric + 0.3 * topology + 0.2 * semantic + 0.1 * engineering,
    }


def boundary_ratios(segments: DataFrame, key: str = "sample_id", spans: Spans | None = None) -> DataFrame:
    """Start of each segment as a share of all samples: ``segments(<key>, idx, samples)``; a segment counts at least 1."""
    keys = [key]
    spans = ensure_spans(segments, keys, "idx", spans)
    size = F.greatest(F.lit(1), F.col("samples")).cast("long")
    rows = with_running(segments, keys, ["idx"], {"_upto": ("sum", size)}, spans)
    rows = with_group(rows, keys, {"_total": F.sum(size)}, spans)
    return rows.select(key, "idx", ((F.col("_upto") - size) / F.greatest(F.lit(1), F.col("_total"))).alias("boundary"))


def breakpoint_mae(truth: DataFrame, predicted: DataFrame, key: str = "sample_id", spans: Spans | None = None) -> DataFrame:
    """Mean distance of each true boundary to the nearest predicted one.

    Both tables hold ``<key>, boundary``. 0 when both are empty, 1 when one is.
    The nearest value comes from running extremes over the merged order, one
    row per boundary and no pairs.
    """
    marks = truth.select(key, "boundary", F.lit(1).alias("kind")).unionByName(predicted.select(key, "boundary", F.lit(0).alias("kind")))
    spans = ensure_spans(marks, [key], "boundary", spans)
    guess = F.when(F.col("kind") == 0, F.col("boundary"))
    # Predictions sort before truths of equal value going up; going down the next larger one is enough.
    rows = with_running(marks, [key], ["boundary", "kind"], {"_below": ("max", guess)}, spans)
    rows = with_running(rows, [key], ["boundary", "kind"], {"_above": ("min", guess)}, spans, reverse=True)
    at = F.col("boundary")
    nearest = F.least(at - F.col("_below"), F.col("_above") - at)
    sums = rows.groupBy(key).agg(
        F.count_if(F.col("kind") == 1).alias("_truth"), F.count_if(F.col("kind") == 0).alias("_guess"),
        F.avg(F.when(F.col("kind") == 1, nearest)).alias("_mean"),
    )
    return sums.select(
        key, F.when((F.col("_truth") == 0) | (F.col("_guess") == 0), F.lit(1.0)).otherwise(F.col("_mean")).alias("breakpoint_mae"),
        F.abs(F.col("_truth") - F.col("_guess")).alias("count_error"),
    )


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two arrays over the longer length; 1 when both are empty.

    One row of the usual table is one integer: a bit of the right array is
    clear where the best length grows. A step is an addition and a few bitwise
    operations, so two arrays of 100,000 items take seconds.
    """

    def one(left, right) -> float:
        if not len(left) or not len(right):
            return float(not len(left) and not len(right))
        digits: dict[object, list[int]] = {}
        for j, item in enumerate(right):
            digits.setdefault(item, []).append(j)
        bits = {}
        for item, places in digits.items():
            marks = np.zeros(len(right), dtype=np.uint8)
            marks[places] = 1
            bits[item] = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
        full = (1 << len(right)) - 1
        row = full
        for item in left:
            hit = row & bits.get(item, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        return (len(right) - row.bit_count()) / max(len(left), len(right))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def map_type(name: Column) -> Column:
    """Segment type in one of the three families, or the trimmed lower-case name."""
    text = F.trim(F.lower(name))
    return F.when(text.isin("arc", "circle"), "arc").when(text.isin("bspline", "spline", "curve"), "spline").otherwise(text)


def effective_params(kind: Column, controls: Column) -> Column:
    """Parameters of one segment: line 1, arc 2, spline 4 to 24, other 3."""
    held = F.when(F.coalesce(controls, F.lit(0)) > 0, controls).otherwise(F.lit(4))
    return F.when(kind == "line", 1).when(kind == "arc", 2).when(
        kind == "spline", F.greatest(F.lit(4), F.least(F.lit(24), held))
    ).otherwise(3).cast("long")


def parsimony_score(predicted: Column, truth: Column) -> Column:
    excess = (predicted - truth) / F.greatest(F.lit(1), truth)
    return F.when(predicted <= truth, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), 0.32 * excess)))


def param_score(mae: Column | str, count_error: Column | str, type_score: Column | str, sparse: Column | str) -> Column:
    breaks = F.greatest(
        F.lit(0.0), 1.0 - F.least(F.lit(1.0), col(mae) / 0.08) - F.least(F.lit(0.4), 0.06 * col(count_error))
    )
    return 0.52 * breaks + 0.30 * col(type_score) + 0.18 * col(sparse)


def main_contour(contours_table: DataFrame, key: str = "sample_id") -> DataFrame:
    """Contour with most samples, the first on ties: ``(<key>, idx, samples, …)``."""
    rest = [c for c in contours_table.columns if c != key]
    best = contours_table.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(F.coalesce("samples", F.lit(0)), -F.col("idx"))).alias("b")
    )
    return best.select(key, "b.*")


REPORT_MEANS = [
    "breakpoint_mae", "count_error", "type_score", "effective_params_truth", "effective_params_predicted", "parsimony", "param_score",
]


def dataset_report(samples: DataFrame) -> DataFrame:
    """Totals and seven means over the successful samples; null with none."""
    ok = F.col("success")
    return samples.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"),
        *[F.avg(F.when(ok, F.col(name))).alias(f"{name}_mean") for name in REPORT_MEANS],
    )


def level_report(samples: DataFrame, levels: list[int] | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
    """Counts and pass rate per complexity level of the selected samples.

    ``samples(idx, level, passed)``; ``start`` skips the first samples, then
    the level filter applies, then the optional ``limit`` in ``idx`` order.
    """
    chosen = samples.filter(F.col("idx") >= start)
    if levels is not None:
        chosen = chosen.filter(F.col("level").isin(levels))
    if limit is not None:
        chosen = chosen.orderBy("idx").limit(limit)
    return chosen.groupBy("level").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
    ).select("*", (F.col("passed") / F.col("total") * 100).alias("pass_rate"))
