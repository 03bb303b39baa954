"""Curve analytics over ``sweeps(design_id, freq, value)``.

The windowed operators take ``spans`` (see ``plans.ordered``); when it is left
out they measure the table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.functions.numeric import clip, is_finite, rounded
from sweepfield.plans.ordered import (
    Spans,
    ensure_spans,
    with_group,
    with_neighbours,
    with_position,
    with_running,
)
from sweepfield.plans.sizing import broadcast_if_small

KEY = ["design_id"]


def complex_to_db(re: Column, im: Column) -> Column:
    """Magnitude of a complex response in dB; zero gives minus infinity."""
    size = F.hypot(re, im)
    return F.when(size <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(size))


def clean_sweep(df: DataFrame) -> DataFrame:
    """Rows whose frequency and value are both finite."""
    return df.filter(is_finite(F.col("freq")) & is_finite(F.col("value")))


def global_minimum(df: DataFrame) -> DataFrame:
    """Deepest sample of each curve; ties go to the lowest frequency."""
    best = F.min(F.struct("value", "freq"))
    return df.groupBy(*KEY).agg(best.alias("best")).select(
        *KEY, F.col("best.freq").alias("freq"), F.col("best.value").alias("value")
    )


def flag_minima(df: DataFrame, spans: Spans) -> DataFrame:
    """Add ``is_minimum``: the middle sample of each interior dip or flat bottom.

    A flat stretch at the curve's start is looked at from its second sample on;
    one that reaches the last sample is no minimum. Curves under three samples
    mark every row.
    """
    rows = with_neighbours(df, KEY, ["freq"], ["freq", "value"], spans)
    rows = with_position(rows, KEY, ["freq"], spans)
    head = F.col("prev").isNull() | (F.col("prev.value") != F.col("value"))
    tail = F.col("next").isNull() | (F.col("next.value") != F.col("value"))
    rows = with_running(
        rows, KEY, ["freq"],
        {"_from": ("max", F.when(head, F.struct("position", F.col("prev.value").alias("outside"))))}, spans,
    )
    rows = with_running(
        rows, KEY, ["freq"],
        {"_to": ("min", F.when(tail, F.struct("position", F.col("next.value").alias("outside"))))},
        spans, reverse=True,
    )
    rows = with_group(rows, KEY, {"_size": F.count(F.lit(1))}, spans)
    at_start = F.col("_from.position") == 1
    first = F.col("_from.position") + at_start.cast("long")
    length = F.col("_to.position") - first + 1
    middle = first + F.floor(length / 2)
    lower_left = at_start | (F.col("value") < F.col("_from.outside"))
    lower_right = F.col("value") < F.col("_to.outside")
    dip = lower_left & lower_right & (length > 0) & (F.col("position") == middle)
    flag = F.when(F.col("_size") < 3, F.lit(True)).otherwise(F.coalesce(dip, F.lit(False)))
    return rows.select(*df.columns, "prev", "next", flag.alias("is_minimum"))


def local_minima(df: DataFrame, spans: Spans | None = None) -> DataFrame:
    spans = ensure_spans(df, KEY, "freq", spans)
    return flag_minima(df, spans).filter("is_minimum").select(*KEY, "freq", "value")


def resonances(
    df: DataFrame, limit: int = 2, threshold: float | Column = -10.0, spans: Spans | None = None
) -> DataFrame:
    """The deepest ``limit`` minima at or below the threshold, one row each.

    Where no local minimum qualifies the global minimum stands in, if it does.
    The row-number filter is applied before the shuffle too, so a long curve
    never reaches one task whole.
    """
    level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    dips = local_minima(df, spans).withColumn("fallback", F.lit(0))
    lowest = global_minimum(df).select(*KEY, "freq", "value", F.lit(1).alias("fallback"))
    order = Window.partitionBy(*KEY).orderBy("fallback", "value", "freq")
    ranked = dips.unionByName(lowest).filter(F.col("value") <= level).withColumn("depth", F.row_number().over(order))
    return ranked.filter(F.col("depth") <= limit).filter((F.col("fallback") == 0) | (F.col("depth") == 1)).select(
        *KEY, "freq", "value", F.col("depth").cast("long").alias("depth")
    )


def bracket(target: Column) -> list[Column]:
    """Aggregates that bracket a target: ends of the curve and samples on either side."""
    sample = F.struct("freq", "value")
    return [
        F.min(sample).alias("_first"),
        F.max(sample).alias("_last"),
        F.max(F.when(F.col("freq") < target, sample)).alias("_below"),
        F.min(F.when(F.col("freq") >= target, sample)).alias("_above"),
    ]


def bracket_value(target: Column) -> Column:
    """Linear interpolation from the ``bracket`` aggregates, clamped at the ends."""
    low, high = F.col("_below"), F.col("_above")
    share = F.try_divide(target - low["freq"], high["freq"] - low["freq"])
    return (
        F.when(target <= F.col("_first.freq"), F.col("_first.value"))
        .when(target >= F.col("_last.freq"), F.col("_last.value"))
        .when(F.abs(high["freq"] - low["freq"]) <= 1e-12, low["value"])
        .otherwise(low["value"] + (high["value"] - low["value"]) * share)
    )


def interpolate_at(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Value at each design's ``target_freq``, as two conditional aggregates."""
    wanted = broadcast_if_small(targets.select(*KEY, "target_freq"))
    target = F.col("target_freq")
    found = df.join(wanted, KEY).groupBy(*KEY, "target_freq").agg(*bracket(target))
    return found.select(*KEY, "target_freq", bracket_value(target).alias("value_at_target"))


def _crossing(a: Column, b: Column, threshold: Column) -> Column:
    """Frequency where the line from sample a to sample b meets the threshold."""
    ratio = clip(F.try_divide(threshold - a["value"], b["value"] - a["value"]), 0.0, 1.0)
    return F.when(F.abs(b["value"] - a["value"]) <= 1e-12, a["freq"]).otherwise(
        a["freq"] + ratio * (b["freq"] - a["freq"])
    )


def flag_bands(rows: DataFrame, threshold: Column, spans: Spans) -> DataFrame:
    """Mark the last row of each run at or below the threshold with the run's edges.

    Needs ``prev`` and ``next``. Frequencies ascend, so the running maximum of
    the start rows is the start of the current run; no regrouping is needed.
    """
    below = F.col("value") <= threshold
    opens = below & F.coalesce(F.col("prev.value") > threshold, F.lit(True))
    closes = below & F.coalesce(F.col("next.value") > threshold, F.lit(True))
    started = with_running(
        rows, KEY, ["freq"], {"_open": ("max", F.when(opens, F.struct("freq", "value", "prev")))}, spans
    )
    here = F.struct("freq", "value")
    cut_in = F.when(F.col("_open.prev").isNull(), F.col("_open.freq")).otherwise(
        _crossing(F.col("_open.prev"), F.col("_open"), threshold)
    )
    cut_out = F.when(F.col("next").isNull(), F.col("freq")).otherwise(_crossing(here, F.col("next"), threshold))
    band = F.struct(
        F.col("_open.freq").alias("start"), F.col("freq").alias("end"),
        cut_in.alias("cut_start"), cut_out.alias("cut_end"),
    )
    return started.withColumn("band", F.when(closes, band)).drop("_open")


def _bands(df: DataFrame, threshold: float | Column, spans: Spans | None) -> DataFrame:
    spans = ensure_spans(df, KEY, "freq", spans)
    level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = with_neighbours(df, KEY, ["freq"], ["freq", "value"], spans)
    return flag_bands(rows, level, spans)


def below_threshold_bands(df: DataFrame, threshold: float = -10.0, spans: Spans | None = None) -> DataFrame:
    """Every run of samples at or below the threshold, with sampled edges."""
    found = _bands(df, threshold, spans).filter(F.col("band").isNotNull())
    return found.select(*KEY, F.col("band.start").alias("band_start"), F.col("band.end").alias("band_end"))


def interpolated_bands(df: DataFrame, threshold: float = -10.0, spans: Spans | None = None) -> DataFrame:
    """The same runs with interpolated crossings; open at the curve's ends."""
    found = _bands(df, threshold, spans).filter(F.col("band").isNotNull())
    return found.select(*KEY, F.col("band.cut_start").alias("band_start"), F.col("band.cut_end").alias("band_end"))


def widest(start: Column, end: Column) -> Column:
    """Aggregate: the widest band as (width, -start, start, end); the first on ties."""
    return F.max(
        F.when(start.isNotNull(), F.struct((end - start).alias("width"), (-start).alias("order"), start.alias("start"), end.alias("end")))
    )


def widest_band(df: DataFrame, threshold: float = -10.0, spans: Spans | None = None) -> DataFrame:
    """Widest sampled band of each design; width 0 and null edges when there is none."""
    rows = _bands(df, threshold, spans)
    best = rows.groupBy(*KEY).agg(widest(F.col("band.start"), F.col("band.end")).alias("best"))
    return best.select(
        *KEY,
        F.coalesce("best.width", F.lit(0.0)).alias("bandwidth"),
        F.col("best.start").alias("band_start"),
        F.col("best.end").alias("band_end"),
    )


def nearest_resonance(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Resonance closest to the target; the lower frequency on ties."""
    wanted = broadcast_if_small(targets.select(*KEY, "target_freq"))
    gap = F.abs(F.col("freq") - F.col("target_freq"))
    return found.join(wanted, KEY).groupBy(*KEY).agg(F.min_by("freq", F.struct(gap, F.col("freq"))).alias("nearest"))


def _flagged(df: DataFrame, level: Column, limit: int, spans: Spans) -> DataFrame:
    """Rows with ``band`` at each band's end and ``picked`` on the resonances.

    Unsplit curves get everything from one shuffle on the design; the ranking
    window shares its partitioning. Split curves join the few picked samples.
    """
    rows = flag_bands(flag_minima(df, spans), level, spans)
    if spans:
        picks = resonances(df, limit, level, spans).select(*KEY, "freq", "value", F.lit(True).alias("_pick"))
        return rows.join(picks, [*KEY, "freq", "value"], "left").withColumn("picked", F.coalesce("_pick", F.lit(False)))
    good = F.col("is_minimum") & (F.col("value") <= level)
    order = Window.partitionBy(*KEY).orderBy(F.desc("_good"), "value", "freq")
    ranked = rows.withColumn("_good", good).withColumn("_depth", F.row_number().over(order))
    # Without a qualifying minimum the first row is the global minimum.
    stand_in = (F.col("_depth") == 1) & (F.col("value") <= level) & F.lit(limit > 0)
    return ranked.withColumn("picked", (F.col("_good") & (F.col("_depth") <= limit)) | stand_in)


def curve_metrics(
    df: DataFrame, targets: DataFrame, threshold: float = -10.0, limit: int = 2, spans: Spans | None = None
) -> DataFrame:
    """One row per design: minimum, value at target, widest band, count, resonances."""
    spans = ensure_spans(df, KEY, "freq", spans)
    flagged = _flagged(df, F.lit(float(threshold)), limit, spans)
    wanted = broadcast_if_small(targets.select(*KEY, "target_freq"))
    target = F.col("target_freq")
    measured = flagged.join(wanted, KEY).groupBy(*KEY, "target_freq").agg(
        F.min(F.struct("value", "freq")).alias("_deepest"),
        F.count(F.lit(1)).alias("point_count"),
        widest(F.col("band.start"), F.col("band.end")).alias("_band"),
        F.array_sort(F.collect_list(F.when(F.col("picked"), F.col("freq")))).alias("resonances"),
        *bracket(target),
    )
    return measured.select(
        *KEY,
        F.col("_deepest.freq").alias("resonant_freq"),
        F.col("_deepest.value").alias("minimum_value"),
        bracket_value(target).alias("value_at_target"),
        F.coalesce("_band.width", F.lit(0.0)).alias("bandwidth"),
        F.col("_band.start").alias("band_start"),
        F.col("_band.end").alias("band_end"),
        "point_count",
        "resonances",
    )


def overall_pass(s11: Column, gain: Column, bandwidth: Column) -> Column:
    """False if any part fails, null if a required part is unknown, else true."""
    failed = F.coalesce(~s11, F.lit(False)) | F.coalesce(~gain, F.lit(False)) | F.coalesce(~bandwidth, F.lit(False))
    unknown = s11.isNull() | gain.isNull()
    return F.when(failed, F.lit(False)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def simulation_summary(
    df: DataFrame,
    targets: DataFrame,
    target_s11: float = -15.0,
    target_gain: float = 6.0,
    threshold: float | None = None,
    limit: int = 3,
    spans: Spans | None = None,
) -> DataFrame:
    """Target, current, gap and passed blocks of every design.

    ``targets`` holds ``target_freq`` and nullable ``target_bandwidth`` and ``gain``.
    """
    spans = ensure_spans(df, KEY, "freq", spans)
    level = float(target_s11 if threshold is None else threshold)
    flagged = _flagged(df, F.lit(level), limit, spans)
    wanted = broadcast_if_small(targets.select(*KEY, "target_freq", "target_bandwidth", "gain"))
    target = F.col("target_freq")
    miss = F.struct(F.abs(F.col("freq") - target), F.col("freq"))
    measured = flagged.join(wanted, KEY).groupBy(*KEY, "target_freq", "target_bandwidth", "gain").agg(
        F.min_by("freq", F.when(F.col("picked"), miss)).alias("nearest"),
        F.min(F.struct("value", "freq")).alias("_deepest"),
        F.count(F.lit(1)).alias("point_count"),
        widest(F.col("band.cut_start"), F.col("band.cut_end")).alias("_band"),
        *bracket(target),
    )
    joined = measured.select(
        *KEY, "target_freq", "target_bandwidth", "point_count",
        rounded(F.coalesce("nearest", "_deepest.freq")).alias("f0"),
        rounded(F.coalesce("nearest", "_deepest.freq") - target).alias("frequency_error"),
        rounded(bracket_value(target)).alias("s11_at_target"),
        rounded(F.col("_deepest.value")).alias("peak_s11"),
        rounded(F.coalesce("_band.width", F.lit(0.0))).alias("bandwidth"),
        rounded(F.col("gain")).alias("gain"),
    )
    s11_ok = F.col("s11_at_target") <= target_s11
    gain_ok = F.col("gain") >= target_gain
    width_ok = F.col("bandwidth") >= F.col("target_bandwidth")
    return joined.select(
        *KEY,
        F.struct(
            F.col("target_freq").alias("f0"), F.lit(float(target_s11)).alias("s11_max"),
            F.lit(float(target_gain)).alias("gain_min"), F.col("target_bandwidth").alias("bandwidth_min"),
        ).alias("target"),
        F.struct("f0", "s11_at_target", "peak_s11", "gain", "bandwidth").alias("current"),
        F.struct(
            "frequency_error",
            rounded(F.col("s11_at_target") - target_s11).alias("s11_error"),
            rounded(target_gain - F.col("gain")).alias("gain_error"),
            rounded(F.col("target_bandwidth") - F.col("bandwidth")).alias("bandwidth_error"),
        ).alias("gap_to_target"),
        F.struct(
            s11_ok.alias("s11"), gain_ok.alias("gain"), width_ok.alias("bandwidth"),
            overall_pass(s11_ok, gain_ok, width_ok).alias("overall"),
        ).alias("passed"),
        "point_count",
    )
