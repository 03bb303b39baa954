"""Objective scores: column expressions and joins of curves with targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepfield.functions.numeric import EPS, col, finite_or_null
from sweepfield.operators import curves
from sweepfield.plans.sizing import broadcast_if_small

# Weights of the total objective and the failure penalties.
WEIGHTS = {"resonance": 4.0, "resonance_count": 8.0, "s11": 2.0, "bandwidth": 8.0, "gain": 1.0}
INVALID_GEOMETRY = 100.0
SIMULATION_FAILURE = 80.0
# Stage weights of the two partial losses; later stages use the total.
STAGE_WEIGHTS = {
    1: {"ERES": 1.0, "EBW": 1.0},
    2: {"ERES": 0.2, "EBW": 1.0},
    3: {"full_objective": 1.0},
    4: {"full_objective": 1.0},
}
# Target keys in order of preference.
S11_KEYS = ["Target_S11_dB", "S11_Target_dB", "Minimum_S11_dB", "Return_Loss_dB"]


def relative_error(actual: Column, target: Column) -> Column:
    """Absolute difference over the target's size; null when either is unknown."""
    return F.when(
        actual.isNotNull() & target.isNotNull(),
        F.abs(actual - target) / F.greatest(F.abs(target), F.lit(EPS)),
    )


def threshold_error(actual: Column, target: Column) -> Column:
    """Zero at or below the target, else the relative excess; null when either is unknown."""
    excess = (actual - target) / F.greatest(F.abs(target), F.lit(EPS))
    return F.when(actual <= target, F.lit(0.0)).when(actual > target, excess)


def multi_resonance_error(actuals: Column, targets: Column) -> Column:
    """Mean error of positive targets matched by sorted position; a missing one costs 1.

    Both inputs are arrays with a few resonances each.
    """
    wanted = F.array_sort(F.filter(targets, lambda v: v > 0))
    found = F.array_sort(F.filter(actuals, lambda v: v > 0))
    errors = F.transform(wanted, lambda v, i: F.coalesce(relative_error(F.get(found, i), v), F.lit(1.0)))
    total = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)
    return F.when(F.size(wanted) > 0, F.try_divide(total, F.size(wanted)))


def resonance_count_error(count: Column, target: Column) -> Column:
    """Null for targets up to one, 0 on equality, else at least 1."""
    return (
        F.when(target.isNull() | (target <= 1), F.lit(None).cast("double"))
        .when(count == target, F.lit(0.0))
        .otherwise(F.greatest(F.lit(1.0), F.abs(count - target) / target))
    )


def band_compliance(samples: DataFrame, bands: DataFrame, threshold: float = -10.0) -> DataFrame:
    """Mean excess over the threshold inside each design's band.

    ``bands(design_id, band_start, band_end)`` has one row per design. Null
    error for a missing or empty band, 1 when no sample falls inside.
    """
    valid = F.col("band_start").isNotNull() & F.col("band_end").isNotNull() & (F.col("band_end") > F.col("band_start"))
    usable = broadcast_if_small(bands.filter(valid).select("design_id", "band_start", "band_end"))
    excess = F.greatest(F.lit(0.0), F.col("value") - threshold) / max(abs(threshold), EPS)
    inside = samples.join(usable, "design_id").filter(F.col("freq").between(F.col("band_start"), F.col("band_end")))
    found = inside.groupBy("design_id").agg(F.avg(excess).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    return bands.select("design_id", "band_start", "band_end").join(found, "design_id", "left").select(
        "design_id",
        F.when(valid, F.coalesce("_mean", F.lit(1.0))).alias("compliance_error"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("sample_count"),
    )


def weighted_terms(errors: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Weight times error for each term; an unknown error counts as zero."""
    table = {**WEIGHTS, **(weights or {})}
    return {name: F.lit(table[name]) * F.coalesce(error, F.lit(0.0)) for name, error in errors.items()}


def weighted_objective(
    metrics: DataFrame,
    targets: DataFrame,
    compliance: DataFrame,
    weights: dict[str, float] | None = None,
    count_error: bool = False,
) -> DataFrame:
    """Weighted sum of the five errors of every design.

    ``targets`` holds ``resonances array<double>``, ``resonance_count``,
    ``target_s11``, ``target_bandwidth`` and ``target_gain``; ``metrics`` comes
    from ``curve_metrics`` with an added ``gain``. The count error exists but
    is off by default.
    """
    wanted = targets.withColumnRenamed("resonances", "target_resonances")
    rows = metrics.join(broadcast_if_small(wanted), "design_id").join(compliance, "design_id", "left")
    actual = F.when(F.size("resonances") > 0, F.col("resonances")).otherwise(F.array("resonant_freq"))
    count = resonance_count_error(F.size("resonances"), F.col("resonance_count")) if count_error else F.lit(0.0)
    errors = {
        "resonance": multi_resonance_error(actual, F.col("target_resonances")),
        "resonance_count": count,
        "s11": threshold_error(F.col("value_at_target"), F.col("target_s11")),
        "bandwidth": F.coalesce("compliance_error", relative_error(F.col("bandwidth"), F.col("target_bandwidth"))),
        "gain": relative_error(F.col("gain"), F.col("target_gain")),
    }
    terms = weighted_terms(errors, weights)
    total = sum(terms.values(), F.lit(0.0))
    return rows.select(
        "design_id",
        *[error.alias(f"error_{name}") for name, error in errors.items()],
        *[term.alias(f"term_{name}") for name, term in terms.items()],
        F.greatest(total, F.lit(0.0)).alias("total"),
    )


def failure_penalty(total: Column, valid: Column, failed: Column) -> Column:
    """Invalid geometry and failed simulation replace the total; it never drops below zero."""
    return (
        F.when(~valid, F.lit(INVALID_GEOMETRY))
        .when(failed | total.isNull(), F.lit(SIMULATION_FAILURE))
        .otherwise(F.greatest(total, F.lit(0.0)))
    )


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def extract_targets(
    df: DataFrame, json: str, fallback_freq: float = 2.45, fallback_s11: float = -10.0
) -> DataFrame:
    """Targets from instance JSON text with the documented fallbacks.

    Resonances may be a list or a scalar, only positive ones count, and an
    explicit non-positive one switches the term off.
    """
    at = lambda path, kind="double": F.try_variant_get(F.col("_doc"), f"$.Paper_Performance{path}", kind)
    rows = df.withColumn("_doc", F.try_parse_json(json))
    listed = at(".Target_Resonances_GHz", "array<variant>")
    several = F.transform(listed, _number)
    values = F.filter(F.coalesce(several, F.array(at(".Target_Resonances_GHz"))), lambda v: v > 0)
    single = at(".Target_Resonance_GHz")
    absent = at(".Target_Resonances_GHz", "variant").isNull() & at(".Target_Resonance_GHz", "variant").isNull()
    none = F.array().cast("array<double>")
    freqs = (
        F.when(F.size(F.coalesce(values, none)) > 0, values)
        .when(single > 0, F.array(single))
        .when(absent, F.array(F.lit(float(fallback_freq))))
        .otherwise(none)
    )
    banded = at(".Bandwidth_10dB", "map<string,variant>").isNotNull()
    start, end = at(".Bandwidth_10dB.Start_GHz"), at(".Bandwidth_10dB.End_GHz")
    width = F.when(banded, F.coalesce(at(".Bandwidth_10dB.Bandwidth_GHz"), F.abs(end - start))).otherwise(
        at(".Bandwidth_GHz")
    )
    explicit = at(".Resonance_Count")
    s11 = F.coalesce(
        *[at(f".{key}") for key in S11_KEYS], F.when(banded, F.lit(-10.0)), F.lit(float(fallback_s11))
    )
    kept = [c for c in df.columns if c != json]
    found = rows.select(
        *kept,
        freqs.alias("resonances"), width.alias("bandwidth"), start.alias("band_start"), end.alias("band_end"),
        at(".Peak_Gain_dBi").alias("gain"), s11.alias("s11"), explicit.alias("_explicit"),
    )
    count = F.when(F.col("_explicit") > 0, F.greatest(F.lit(1), F.bround("_explicit").cast("int"))).when(
        F.size("resonances") > 1, F.size("resonances")
    )
    return found.withColumn("resonance_count", count).withColumn("resonance", F.get("resonances", F.lit(0))).drop("_explicit")


def objective_profile(description: Column) -> Column:
    """Profile name from keywords of the joined descriptors, in fixed order."""
    text = F.lower(description)
    any_of = lambda words: F.rlike(text, F.lit("|".join(words)))
    return (
        F.when(any_of(["array"]), "ArrayObjective")
        .when(any_of(["fss", "frequency selective"]), "FSSObjective")
        .when(any_of(["multi", "dual", "triple"]), "MultibandPatchObjective")
        .otherwise("WidebandPatchObjective")
    )


def stage_loss(
    stage: Column,
    eres: Column,
    ebw: Column,
    total: Column,
    failure: Column,
    weights: dict[int, dict[str, float]] | None = None,
) -> Column:
    """Loss of the current stage; a failure penalty wins, unusable numbers count as zero."""
    table = {k: {**STAGE_WEIGHTS[k], **(weights or {}).get(k, {})} for k in STAGE_WEIGHTS}
    num = lambda c: F.coalesce(finite_or_null(c), F.lit(0.0))
    part = lambda k: F.lit(table[k]["ERES"]) * num(eres) + F.lit(table[k]["EBW"]) * num(ebw)
    full = lambda k: F.lit(table[k]["full_objective"]) * num(total)
    loss = F.when(stage == 1, part(1)).when(stage == 2, part(2)).when(stage == 3, full(3)).otherwise(full(4))
    return F.when(num(failure) > 0, num(failure)).otherwise(F.greatest(F.lit(0.0), loss))


def single_band_loss(
    df: DataFrame,
    gains: DataFrame,
    target_freq: float = 2.45,
    target_s11: float = -15.0,
    target_gain: float = 6.0,
    weights: tuple[float, float, float] = (5.0, 3.0, 1.0),
) -> DataFrame:
    """Weighted squared frequency miss, matching excess and gain shortfall per design."""
    target = F.lit(float(target_freq))
    found = df.groupBy("design_id").agg(F.min(F.struct("value", "freq")).alias("_best"), *curves.bracket(target))
    rows = found.join(broadcast_if_small(gains.select("design_id", "gain")), "design_id", "left")
    miss = (F.col("_best.freq") - target) / target
    frequency = miss * miss
    matching = F.greatest(F.lit(0.0), (curves.bracket_value(target) - target_s11) / abs(target_s11))
    shortfall = F.greatest(F.lit(0.0), (F.lit(target_gain) - F.col("gain")) / target_gain)
    gain = F.when(F.col("gain").isNull(), F.lit(1.0)).otherwise(shortfall)
    return rows.select(
        "design_id",
        frequency.alias("frequency_loss"), matching.alias("matching_loss"), gain.alias("gain_loss"),
        (weights[0] * frequency + weights[1] * matching + weights[2] * gain).alias("loss"),
    )


def frequency_distance_status(
    df: DataFrame, freq: str, target: float, failed_above: float = 0.5, success_below: float = 0.05, floor: float = 10.0
) -> DataFrame:
    """Distance to the target, its status, and the value reported to an optimiser."""
    distance = F.abs(col(freq) - target)
    status = F.when(distance.isNull() | (distance > failed_above), "failed").when(
        distance < success_below, "success"
    ).otherwise("completed")
    reported = F.when(status == "failed", F.greatest(F.coalesce(distance, F.lit(floor)), F.lit(floor))).otherwise(distance)
    return df.select("*", distance.alias("distance"), status.alias("outcome"), reported.alias("reported"))
