"""Queries over response curves."""

from pyspark.sql import functions as F

from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import curves

MINIMA = """
numbered AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY design_id) AS n,
    lag(value) OVER w AS lv, lead(value) OVER w AS rv FROM sweeps WINDOW w AS (PARTITION BY design_id ORDER BY freq)),
runs AS (SELECT *, sum(CASE WHEN lv IS NULL OR lv <> value THEN 1 ELSE 0 END)
    OVER (PARTITION BY design_id ORDER BY freq) AS run FROM numbered),
shaped AS (SELECT design_id, run, min(p) AS a, max(p) AS b, arg_min(lv, p) AS lv, arg_max(rv, p) AS rv,
    any_value(value) AS value, any_value(n) AS n,
    list(freq ORDER BY freq) AS freqs FROM runs GROUP BY design_id, run),
minima AS (
    SELECT design_id, CASE WHEN a = 1 THEN freqs[2 + (b - a) // 2] ELSE freqs[1 + (b - a + 1) // 2] END AS freq, value
    FROM shaped WHERE n >= 3 AND b < n AND value < rv AND (a > 1 AND value < lv OR a = 1 AND b > 1)
    UNION ALL SELECT design_id, freq, value FROM numbered WHERE n < 3)"""


def resonance_sql(limit, threshold):
    return f"""{MINIMA},
good AS (SELECT design_id, freq, value, row_number() OVER (PARTITION BY design_id ORDER BY value, freq) AS depth
    FROM minima WHERE value <= {threshold}),
lowest AS (SELECT design_id, arg_min(freq, (value, freq)) AS freq, min(value) AS value FROM sweeps GROUP BY design_id),
resonances AS (SELECT * FROM good WHERE depth <= {limit}
    UNION ALL SELECT design_id, freq, value, 1 AS depth FROM lowest
    WHERE value <= {threshold} AND design_id NOT IN (SELECT design_id FROM good))"""


def bands_sql(threshold):
    return f"""
flagged AS (SELECT *, value <= {threshold} AS below,
    row_number() OVER (PARTITION BY design_id ORDER BY freq)
    - row_number() OVER (PARTITION BY design_id, value <= {threshold} ORDER BY freq) AS g,
    lag(freq) OVER w AS pf, lag(value) OVER w AS pv, lead(freq) OVER w AS nf, lead(value) OVER w AS nv
    FROM sweeps WINDOW w AS (PARTITION BY design_id ORDER BY freq)),
bands AS (SELECT design_id, min(freq) AS band_start, max(freq) AS band_end,
    arg_min(freq, freq) AS f0, arg_min(value, freq) AS v0, arg_min(pf, freq) AS pf, arg_min(pv, freq) AS pv,
    arg_max(freq, freq) AS f1, arg_max(value, freq) AS v1, arg_max(nf, freq) AS nf, arg_max(nv, freq) AS nv
    FROM flagged WHERE below GROUP BY design_id, g),
crossed AS (SELECT design_id, band_start, band_end,
    CASE WHEN pf IS NULL THEN f0 WHEN abs(v0 - pv) <= 1e-12 THEN pf
      ELSE pf + greatest(0.0, least(1.0, ({threshold} - pv) / (v0 - pv))) * (f0 - pf) END AS cut_start,
    CASE WHEN nf IS NULL THEN f1 WHEN abs(nv - v1) <= 1e-12 THEN f1
      ELSE f1 + greatest(0.0, least(1.0, ({threshold} - v1) / (nv - v1))) * (nf - f1) END AS cut_end FROM bands)"""


VALUE_AT = """
around AS (SELECT s.design_id, t.target_freq, min(s.freq) AS first_f, arg_min(s.value, s.freq) AS first_v,
    max(s.freq) AS last_f, arg_max(s.value, s.freq) AS last_v,
    max(s.freq) FILTER (s.freq < target_freq) AS f0, arg_max(s.value, s.freq) FILTER (s.freq < target_freq) AS v0,
    min(s.freq) FILTER (s.freq >= target_freq) AS f1, arg_min(s.value, s.freq) FILTER (s.freq >= target_freq) AS v1,
    count(*) AS point_count
    FROM sweeps s JOIN targets t ON s.design_id = t.design_id GROUP BY s.design_id, t.target_freq),
at_target AS (SELECT design_id, target_freq, point_count, CASE WHEN target_freq <= first_f THEN first_v
    WHEN target_freq >= last_f THEN last_v
    WHEN abs(f1 - f0) <= 1e-12 THEN v0
    ELSE v0 + (v1 - v0) * ((target_freq - f0) / (f1 - f0)) END AS v FROM around)"""


@register("global_minimum", "SELECT design_id, arg_min(freq, (value, freq)) AS freq, min(value) AS value FROM sweeps GROUP BY design_id")
def _(t):
    return curves.global_minimum(t.sweeps())


@register("clean_sweep", """WITH raw AS (SELECT design_id, freq, CASE WHEN freq::BIGINT % 50 = 7 THEN 'NaN'::DOUBLE
    WHEN freq::BIGINT % 50 = 9 THEN 'Infinity'::DOUBLE ELSE value END AS value FROM sweeps)
    SELECT design_id, count(*) AS kept, min(value) AS low, max(value) AS high FROM raw
    WHERE isfinite(value) AND isfinite(freq) GROUP BY design_id""")
def _(t):
    hour = F.round("freq").cast("long") % 50
    dirty = t.sweeps().withColumn(
        "value", F.when(hour == 7, F.lit(float("nan"))).when(hour == 9, F.lit(float("inf"))).otherwise(F.col("value"))
    )
    return curves.clean_sweep(dirty).groupBy("design_id").agg(
        F.count("value").alias("kept"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@register("complex_to_db", """SELECT event_id, CASE WHEN re = 0 AND im = 0 THEN '-inf'
    ELSE round(20 * log10(sqrt(re * re + im * im)), 4)::DECIMAL(18, 4)::VARCHAR END AS db
    FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS re, value / 500 AS im FROM events)""")
def _(t):
    rows = t.table("events").select(
        "event_id", ((F.col("event_id") % 101) / F.lit(100.0)).alias("re"), (F.col("value") / 500).alias("im")
    )
    db = curves.complex_to_db(F.col("re"), F.col("im"))
    text = F.when(db == float("-inf"), "-inf").otherwise(F.round(db, 4).cast("decimal(18,4)").cast("string"))
    return rows.select("event_id", text.alias("db"))


@register("local_minima", f"WITH {MINIMA} SELECT design_id, freq, value FROM minima")
def _(t):
    return curves.local_minima(t.sweeps(), t.spans("sweeps"))


@register("resonances", f"WITH {resonance_sql(2, -10.0)} SELECT design_id, freq, value, depth FROM resonances")
def _(t):
    return curves.resonances(t.sweeps(), spans=t.spans("sweeps"))


@register("interpolate_at", f"WITH {VALUE_AT} SELECT design_id, target_freq, round(v, 6) AS value_at_target FROM at_target")
def _(t):
    out = curves.interpolate_at(t.sweeps(), t.targets())
    return out.withColumn("value_at_target", rounded(F.col("value_at_target")))


@register("below_threshold_bands", f"WITH {bands_sql(-20.0)} SELECT design_id, band_start, band_end FROM bands")
def _(t):
    return curves.below_threshold_bands(t.sweeps(), -20.0, t.spans("sweeps"))


@register("widest_band", f"""WITH {bands_sql(-20.0)},
    best AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY band_end - band_start DESC, band_start) AS k FROM bands)
    SELECT d.design_id, round(coalesce(band_end - band_start, 0.0), 6) AS bandwidth, band_start, band_end
    FROM (SELECT DISTINCT design_id FROM sweeps) d LEFT JOIN best b ON d.design_id = b.design_id AND k = 1""")
def _(t):
    out = curves.widest_band(t.sweeps(), -20.0, t.spans("sweeps"))
    return out.withColumn("bandwidth", rounded(F.col("bandwidth")))


@register("interpolated_bands", f"""WITH {bands_sql(-20.0)}
    SELECT design_id, round(cut_start, 6) AS band_start, round(cut_end, 6) AS band_end FROM crossed""")
def _(t):
    out = curves.interpolated_bands(t.sweeps(), -20.0, t.spans("sweeps"))
    return out.select("design_id", rounded(F.col("band_start")).alias("band_start"), rounded(F.col("band_end")).alias("band_end"))


@register("nearest_resonance", f"""WITH {resonance_sql(3, -20.0)}
    SELECT r.design_id, arg_min(r.freq, (abs(r.freq - t.target_freq), r.freq)) AS nearest
    FROM resonances r JOIN targets t ON r.design_id = t.design_id GROUP BY r.design_id""")
def _(t):
    found = curves.resonances(t.sweeps(), 3, -20.0, t.spans("sweeps"))
    return curves.nearest_resonance(found, t.targets())


@register("curve_metrics", f"""WITH {resonance_sql(2, -20.0)},{bands_sql(-20.0)},{VALUE_AT},
    best AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY band_end - band_start DESC, band_start) AS k FROM bands),
    lists AS (SELECT design_id, count(*) AS m, min(freq) AS lo, max(freq) AS hi FROM resonances GROUP BY design_id)
    SELECT a.design_id, l.freq AS resonant_freq, l.value AS minimum_value, round(a.v, 6) AS value_at_target,
      round(coalesce(b.band_end - b.band_start, 0.0), 6) AS bandwidth, b.band_start, b.band_end, a.point_count,
      coalesce(m, 0) AS resonance_count, r.lo AS resonance_low, r.hi AS resonance_high
    FROM at_target a JOIN lowest l ON a.design_id = l.design_id
    LEFT JOIN best b ON a.design_id = b.design_id AND b.k = 1 LEFT JOIN lists r ON a.design_id = r.design_id""")
def _(t):
    out = curves.curve_metrics(t.sweeps(), t.targets(), -20.0, 2, t.spans("sweeps"))
    return out.select(
        "design_id", "resonant_freq", "minimum_value", rounded(F.col("value_at_target")).alias("value_at_target"),
        rounded(F.col("bandwidth")).alias("bandwidth"), "band_start", "band_end", "point_count",
        F.size("resonances").cast("long").alias("resonance_count"),
        F.get("resonances", F.lit(0)).alias("resonance_low"),
        F.get("resonances", F.size("resonances") - 1).alias("resonance_high"),
    )


SUMMARY_TARGETS = """wanted AS (SELECT design_id, target_freq,
    CASE WHEN design_id % 3 = 0 THEN NULL ELSE 20.0::DOUBLE END AS target_bandwidth,
    CASE WHEN design_id % 5 = 0 THEN NULL ELSE (design_id % 10)::DOUBLE END AS gain FROM targets)"""


def summary_targets(t):
    d = F.col("design_id")
    return t.targets().select(
        "design_id", "target_freq",
        F.when(d % 3 != 0, F.lit(20.0)).alias("target_bandwidth"),
        F.when(d % 5 != 0, (d % 10).cast("double")).alias("gain"),
    )


@register("simulation_summary", f"""WITH {resonance_sql(3, -15.0)},{bands_sql(-15.0)},{VALUE_AT},{SUMMARY_TARGETS},
    wide AS (SELECT design_id, max(cut_end - cut_start) AS w FROM crossed GROUP BY design_id),
    near AS (SELECT r.design_id, arg_min(r.freq, (abs(r.freq - w.target_freq), r.freq)) AS f
      FROM resonances r JOIN wanted w ON r.design_id = w.design_id GROUP BY r.design_id),
    flat AS (SELECT a.design_id, a.target_freq, round(coalesce(n.f, l.freq), 6) AS f0,
      round(coalesce(n.f, l.freq) - a.target_freq, 6) AS frequency_error, round(a.v, 6) AS s11_at_target,
      round(l.value, 6) AS peak_s11, round(coalesce(w.w, 0.0), 6) AS bandwidth, q.gain, q.target_bandwidth, a.point_count
      FROM at_target a JOIN lowest l ON a.design_id = l.design_id JOIN wanted q ON a.design_id = q.design_id
      LEFT JOIN wide w ON a.design_id = w.design_id LEFT JOIN near n ON a.design_id = n.design_id)
    SELECT design_id, f0, frequency_error, s11_at_target, peak_s11, bandwidth, gain, point_count,
      round(s11_at_target + 15.0, 6) AS s11_error, round(6.0 - gain, 6) AS gain_error,
      round(target_bandwidth - bandwidth, 6) AS bandwidth_error,
      s11_at_target <= -15.0 AS s11_ok, gain >= 6.0 AS gain_ok, bandwidth >= target_bandwidth AS bandwidth_ok,
      CASE WHEN s11_at_target > -15.0 OR gain < 6.0 OR bandwidth < target_bandwidth THEN false
        WHEN gain IS NULL OR s11_at_target IS NULL THEN NULL ELSE true END AS overall FROM flat""")
def _(t):
    out = curves.simulation_summary(t.sweeps(), summary_targets(t), spans=t.spans("sweeps"))
    return out.select(
        "design_id", "current.f0", "gap_to_target.frequency_error", "current.s11_at_target", "current.peak_s11",
        "current.bandwidth", "current.gain", "point_count", "gap_to_target.s11_error", "gap_to_target.gain_error",
        "gap_to_target.bandwidth_error", F.col("passed.s11").alias("s11_ok"), F.col("passed.gain").alias("gain_ok"),
        F.col("passed.bandwidth").alias("bandwidth_ok"), "passed.overall",
    )


@register("overall_pass", """SELECT event_id, CASE WHEN a = false OR b = false OR c = false THEN false
    WHEN a IS NULL OR b IS NULL THEN NULL ELSE true END AS overall FROM (SELECT event_id,
    CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN value > 50 END AS a,
    CASE event_id % 7 WHEN 0 THEN NULL ELSE value > 20 END AS b,
    CASE event_id % 5 WHEN 0 THEN NULL ELSE value > 10 END AS c FROM events)""")
def _(t):
    i, v = F.col("event_id"), F.col("value")
    parts = t.table("events").select(
        "event_id",
        F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, v > 50).alias("a"),
        F.when(i % 7 != 0, v > 20).alias("b"),
        F.when(i % 5 != 0, v > 10).alias("c"),
    )
    return parts.select("event_id", curves.overall_pass(F.col("a"), F.col("b"), F.col("c")).alias("overall"))
