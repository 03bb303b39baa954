"""Queries over objective scores."""

from pyspark.sql import functions as F

from sweepfield.catalog.curves import VALUE_AT, bands_sql, resonance_sql
from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import curves, objectives


def pairs(t):
    """Actual and target numbers from events; every seventh target is unknown."""
    return t.table("events").select(
        "event_id", F.col("value").alias("actual"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 60).cast("double")).alias("target"),
    )


PAIRS = """pairs AS (SELECT event_id, value AS actual,
    CASE WHEN event_id % 7 <> 0 THEN (event_id % 60)::DOUBLE END AS target FROM events)"""


@register("relative_error", f"""WITH {PAIRS} SELECT event_id,
    round(abs(actual - target) / greatest(abs(target), 1e-9), 9) AS error FROM pairs""")
def _(t):
    return pairs(t).select(
        "event_id", rounded(objectives.relative_error(F.col("actual"), F.col("target")), 9).alias("error")
    )


@register("threshold_error", f"""WITH {PAIRS} SELECT event_id, CASE WHEN actual <= target THEN 0.0::DOUBLE
    WHEN target IS NOT NULL THEN round((actual - target) / greatest(abs(target), 1e-9), 9) END AS error FROM pairs""")
def _(t):
    return pairs(t).select(
        "event_id", rounded(objectives.threshold_error(F.col("actual"), F.col("target")), 9).alias("error")
    )


@register("multi_resonance_error", f"""WITH {resonance_sql(3, -20.0)},
    found AS (SELECT design_id, freq, row_number() OVER (PARTITION BY design_id ORDER BY freq) AS k FROM resonances WHERE freq > 0),
    wanted AS (SELECT design_id, v, row_number() OVER (PARTITION BY design_id ORDER BY v) AS k FROM (
      SELECT design_id, unnest([target_freq, target_freq / 2, (design_id % 4)::DOUBLE * 100, -5.0]) AS v FROM targets) WHERE v > 0)
    SELECT w.design_id, round(avg(coalesce(abs(f.freq - w.v) / greatest(abs(w.v), 1e-9), 1.0)), 6) AS error
    FROM wanted w LEFT JOIN found f ON w.design_id = f.design_id AND w.k = f.k GROUP BY w.design_id""")
def _(t):
    found = curves.resonances(t.sweeps(), 3, -20.0, t.spans("sweeps")).groupBy("design_id").agg(
        F.collect_list("freq").alias("found")
    )
    wanted = t.targets().select(
        "design_id",
        F.array("target_freq", F.col("target_freq") / 2, (F.col("design_id") % 4).cast("double") * 100, F.lit(-5.0)).alias("wanted"),
    )
    rows = wanted.join(found, "design_id", "left")
    none = F.array().cast("array<double>")
    error = objectives.multi_resonance_error(F.coalesce("found", none), F.col("wanted"))
    return rows.select("design_id", rounded(error).alias("error"))


@register("resonance_count_error", """SELECT o_orderkey, CASE WHEN t IS NULL OR t <= 1 THEN NULL WHEN n = t THEN 0.0::DOUBLE
    ELSE greatest(1.0, round(abs(n - t)::DOUBLE / t, 6)) END AS error
    FROM (SELECT o_orderkey, o_orderkey % 9 AS n, nullif(o_orderkey % 4, 0) AS t FROM orders)""")
def _(t):
    key = F.col("o_orderkey")
    rows = t.table("orders").select("o_orderkey", (key % 9).alias("n"), F.nullif(key % 4, F.lit(0)).alias("t"))
    return rows.select("o_orderkey", rounded(objectives.resonance_count_error(F.col("n"), F.col("t"))).alias("error"))


BANDS = """wanted_bands AS (SELECT design_id, CASE WHEN design_id % 11 = 0 THEN NULL ELSE band_start + design_id END AS band_start,
    CASE WHEN design_id % 13 = 0 THEN 10.0 WHEN design_id % 17 = 0 THEN 1e9 ELSE band_end END
      AS band_end, design_id % 17 = 0 AS far FROM targets),
    used AS (SELECT design_id, CASE WHEN far THEN 1e8 ELSE band_start END AS band_start, band_end FROM wanted_bands)"""

COMPLIANCE = f"""{BANDS},
    hits AS (SELECT u.design_id, avg(greatest(0.0, s.value + 10) / 10) AS m, count(*) AS n FROM used u
      JOIN sweeps s ON s.design_id = u.design_id AND s.freq BETWEEN u.band_start AND u.band_end
      WHERE u.band_end > u.band_start GROUP BY u.design_id),
    compliance AS (SELECT u.design_id, CASE WHEN u.band_start IS NULL OR u.band_end <= u.band_start THEN NULL
      ELSE coalesce(m, 1.0) END AS compliance_error, coalesce(n, 0) AS sample_count
      FROM used u LEFT JOIN hits h ON u.design_id = h.design_id)"""


def wanted_bands(t):
    d = F.col("design_id")
    return t.targets().select(
        "design_id",
        F.when(d % 17 == 0, F.lit(1e8)).when(d % 11 != 0, F.col("band_start") + d).alias("band_start"),
        F.when(d % 13 == 0, F.lit(10.0)).when(d % 17 == 0, F.lit(1e9)).otherwise(F.col("band_end")).alias("band_end"),
    )


@register("band_compliance", f"""WITH {COMPLIANCE}
    SELECT design_id, round(compliance_error, 6) AS compliance_error, sample_count FROM compliance""")
def _(t):
    out = objectives.band_compliance(t.sweeps(), wanted_bands(t))
    return out.withColumn("compliance_error", rounded(F.col("compliance_error")))


@register("weighted_objective", f"""WITH {resonance_sql(2, -20.0)},{bands_sql(-20.0)},{VALUE_AT},{COMPLIANCE},
    wide AS (SELECT design_id, max(band_end - band_start) AS w FROM bands GROUP BY design_id),
    actual AS (SELECT l.design_id, coalesce(r.freq, l.freq) AS freq,
        row_number() OVER (PARTITION BY l.design_id ORDER BY coalesce(r.freq, l.freq)) AS k
      FROM lowest l LEFT JOIN resonances r ON l.design_id = r.design_id),
    wanted AS (SELECT design_id, unnest([target_freq / 2, target_freq]) AS v, unnest([1, 2]) AS k FROM targets),
    res AS (SELECT w.design_id, avg(coalesce(abs(a.freq - w.v) / greatest(abs(w.v), 1e-9), 1.0)) AS e FROM wanted w
      LEFT JOIN actual a ON a.design_id = w.design_id AND a.k = w.k GROUP BY w.design_id),
    errors AS (SELECT v.design_id, res.e AS error_resonance, 0.0::DOUBLE AS error_resonance_count,
      CASE WHEN v.v <= -20.0 THEN 0.0 ELSE (v.v + 20.0) / 20.0 END AS error_s11,
      coalesce(c.compliance_error, abs(coalesce(w.w, 0.0) - 20.0) / 20.0) AS error_bandwidth,
      CASE WHEN v.design_id % 5 = 0 THEN NULL ELSE abs((v.design_id % 10)::DOUBLE - 6.0) / 6.0 END AS error_gain
      FROM at_target v JOIN res ON v.design_id = res.design_id LEFT JOIN compliance c ON v.design_id = c.design_id
      LEFT JOIN wide w ON v.design_id = w.design_id)
    SELECT design_id, round(error_resonance, 6) AS error_resonance, error_resonance_count, round(error_s11, 6) AS error_s11,
      round(error_bandwidth, 6) AS error_bandwidth, round(error_gain, 6) AS error_gain,
      round(4.0 * error_resonance + 2.0 * error_s11 + 8.0 * coalesce(error_bandwidth, 0.0) + coalesce(error_gain, 0.0), 5) AS total
    FROM errors""")
def _(t):
    d = F.col("design_id")
    metrics = curves.curve_metrics(t.sweeps(), t.targets(), -20.0, 2, t.spans("sweeps")).withColumn(
        "gain", F.when(d % 5 != 0, (d % 10).cast("double"))
    ).drop("band_start", "band_end")
    wanted = t.targets().select(
        "design_id", F.array(F.col("target_freq") / 2, F.col("target_freq")).alias("resonances"),
        F.lit(2).alias("resonance_count"), F.lit(-20.0).alias("target_s11"),
        F.lit(20.0).alias("target_bandwidth"), F.lit(6.0).alias("target_gain"),
    )
    out = objectives.weighted_objective(metrics, wanted, objectives.band_compliance(t.sweeps(), wanted_bands(t)))
    names = ["resonance", "resonance_count", "s11", "bandwidth", "gain"]
    return out.select(
        "design_id", *[rounded(F.col(f"error_{n}")).alias(f"error_{n}") for n in names],
        rounded(F.col("total"), 5).alias("total"),
    )


@register("failure_penalty", """SELECT trial_id, CASE WHEN trial_id % 5 = 0 THEN 100.0::DOUBLE WHEN status = 'failed' THEN 80.0
    ELSE greatest(objective - 1, 0.0) END AS total FROM trials""")
def _(t):
    total = objectives.failure_penalty(F.col("objective") - 1, F.col("trial_id") % 5 != 0, F.col("status") == "failed")
    return t.trials().select("trial_id", total.alias("total"))


# One instance text per part, in six shapes that cover every fallback.
INSTANCES = """instances AS (SELECT p_partkey, '{"Paper_Performance": {' || CASE p_partkey % 6
    WHEN 0 THEN '"Target_Resonances_GHz": [' || p_size || ', 0, "7.5"], "Resonance_Count": 2.5, "Target_S11_dB": -12.5, "Bandwidth_10dB": {"Start_GHz": 4, "End_GHz": ' || p_size || '}'
    WHEN 1 THEN '"Target_Resonances_GHz": ' || p_size || '.5, "Peak_Gain_dBi": "6.25", "S11_Target_dB": "-9.5"'
    WHEN 2 THEN '"Target_Resonances_GHz": [0.0], "Bandwidth_10dB": {"Bandwidth_GHz": ' || p_size || ', "Start_GHz": 1}'
    WHEN 3 THEN '"Bandwidth_GHz": 3, "Peak_Gain_dBi": "n/a", "Minimum_S11_dB": null'
    WHEN 4 THEN '"Target_Resonance_GHz": "' || p_size || '", "Return_Loss_dB": -14'
    ELSE '"Target_Resonances_GHz": [1.5, 3.5, -2], "Bandwidth_10dB": 12' END
    || '}, "Antenna_Type": {"kind": "' || p_type || '", "form": "' || p_name || '"}}' AS doc FROM part)"""


def instances(t):
    k, s = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    inner = (
        F.when(k == 0, F.concat(F.lit('"Target_Resonances_GHz": ['), s, F.lit(', 0, "7.5"], "Resonance_Count": 2.5, "Target_S11_dB": -12.5, "Bandwidth_10dB": {"Start_GHz": 4, "End_GHz": '), s, F.lit("}")))
        .when(k == 1, F.concat(F.lit('"Target_Resonances_GHz": '), s, F.lit('.5, "Peak_Gain_dBi": "6.25", "S11_Target_dB": "-9.5"')))
        .when(k == 2, F.concat(F.lit('"Target_Resonances_GHz": [0.0], "Bandwidth_10dB": {"Bandwidth_GHz": '), s, F.lit(', "Start_GHz": 1}')))
        .when(k == 3, F.lit('"Bandwidth_GHz": 3, "Peak_Gain_dBi": "n/a", "Minimum_S11_dB": null'))
        .when(k == 4, F.concat(F.lit('"Target_Resonance_GHz": "'), s, F.lit('", "Return_Loss_dB": -14')))
        .otherwise('"Target_Resonances_GHz": [1.5, 3.5, -2], "Bandwidth_10dB": 12')
    )
    doc = F.concat(
        F.lit('{"Paper_Performance": {'), inner, F.lit('}, "Antenna_Type": {"kind": "'), F.col("p_type"),
        F.lit('", "form": "'), F.col("p_name"), F.lit('"}}'),
    )
    return t.table("part").select("p_partkey", doc.alias("doc"))


@register("extract_targets", f"""WITH {INSTANCES},
    parsed AS (SELECT p_partkey, doc::JSON -> '$.Paper_Performance' AS p FROM instances),
    flat AS (SELECT p_partkey, p,
      CASE json_type(p -> '$.Target_Resonances_GHz') WHEN 'ARRAY' THEN list_filter(list_transform((p -> '$.Target_Resonances_GHz')::JSON[], lambda j: TRY_CAST(j ->> '$' AS DOUBLE)), lambda v: v > 0)
        ELSE list_filter([TRY_CAST(p ->> '$.Target_Resonances_GHz' AS DOUBLE)], lambda v: v > 0) END AS many,
      TRY_CAST(p ->> '$.Target_Resonance_GHz' AS DOUBLE) AS one,
      json_exists(p, '$.Target_Resonances_GHz') OR json_exists(p, '$.Target_Resonance_GHz') AS given,
      coalesce(json_type(p -> '$.Bandwidth_10dB') = 'OBJECT', false) AS banded,
      TRY_CAST(p ->> '$.Bandwidth_10dB.Start_GHz' AS DOUBLE) AS a, TRY_CAST(p ->> '$.Bandwidth_10dB.End_GHz' AS DOUBLE) AS b,
      TRY_CAST(p ->> '$.Resonance_Count' AS DOUBLE) AS c FROM parsed),
    chosen AS (SELECT *, CASE WHEN len(many) > 0 THEN many WHEN one > 0 THEN [one] WHEN NOT given THEN [2.45::DOUBLE] ELSE []::DOUBLE[] END AS res FROM flat)
    SELECT p_partkey, len(res)::BIGINT AS found, res[1] AS first_freq, res[-1] AS last_freq,
      CASE WHEN banded THEN coalesce(TRY_CAST(p ->> '$.Bandwidth_10dB.Bandwidth_GHz' AS DOUBLE), abs(b - a))
        ELSE TRY_CAST(p ->> '$.Bandwidth_GHz' AS DOUBLE) END AS bandwidth,
      a AS band_start, b AS band_end, TRY_CAST(p ->> '$.Peak_Gain_dBi' AS DOUBLE) AS gain,
      coalesce(TRY_CAST(p ->> '$.Target_S11_dB' AS DOUBLE), TRY_CAST(p ->> '$.S11_Target_dB' AS DOUBLE),
        TRY_CAST(p ->> '$.Minimum_S11_dB' AS DOUBLE), TRY_CAST(p ->> '$.Return_Loss_dB' AS DOUBLE), CASE WHEN banded THEN -10.0 END, -11.0) AS s11,
      CASE WHEN c > 0 THEN greatest(1, round_even(c, 0)::BIGINT) WHEN len(res) > 1 THEN len(res)::BIGINT END AS resonance_count
    FROM chosen""")
def _(t):
    out = objectives.extract_targets(instances(t), "doc", 2.45, -11.0)
    return out.select(
        "p_partkey", F.size("resonances").cast("long").alias("found"), F.get("resonances", F.lit(0)).alias("first_freq"),
        F.element_at("resonances", F.when(F.size("resonances") > 0, F.lit(-1))).alias("last_freq"),
        "bandwidth", "band_start", "band_end", "gain", "s11", F.col("resonance_count").cast("long").alias("resonance_count"),
    )


@register("objective_profile", """WITH words AS (SELECT p_partkey, lower(p_type || ' ' || p_name || CASE p_partkey % 5
      WHEN 0 THEN ' Phased ARRAY' WHEN 1 THEN ' Frequency Selective surface' WHEN 2 THEN ' dual band' WHEN 3 THEN ' Wideband' ELSE '' END) AS d FROM part)
    SELECT p_partkey, CASE WHEN contains(d, 'array') THEN 'ArrayObjective'
      WHEN contains(d, 'fss') OR contains(d, 'frequency selective') THEN 'FSSObjective'
      WHEN contains(d, 'multi') OR contains(d, 'dual') OR contains(d, 'triple') THEN 'MultibandPatchObjective'
      ELSE 'WidebandPatchObjective' END AS profile FROM words""")
def _(t):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " Phased ARRAY").when(k == 1, " Frequency Selective surface").when(k == 2, " dual band").when(
        k == 3, " Wideband"
    ).otherwise("")
    text = F.concat("p_type", F.lit(" "), "p_name", tail)
    return t.table("part").select("p_partkey", objectives.objective_profile(text).alias("profile"))


@register("stage_loss", """SELECT trial_id, round(CASE WHEN status = 'failed' AND trial_id % 2 = 0 THEN 80.0
    WHEN trial_id % 4 = 0 THEN objective + (trial_id % 10) WHEN trial_id % 4 = 1 THEN 0.2 * objective + (trial_id % 10)
    ELSE CASE WHEN trial_id % 7 = 0 THEN 0.0 ELSE 3 * objective END END, 9) AS loss FROM trials""")
def _(t):
    k = F.col("trial_id")
    loss = objectives.stage_loss(
        (k % 4 + 1), F.col("objective"), (k % 10).cast("double"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(3 * F.col("objective")),
        F.when((F.col("status") == "failed") & (k % 2 == 0), F.lit(80.0)),
    )
    return t.trials().select("trial_id", rounded(loss, 9).alias("loss"))


@register("single_band_loss", """WITH around AS (SELECT design_id, arg_min(freq, (value, freq)) AS f,
      min(freq) AS ff, arg_min(value, freq) AS fv, max(freq) AS lf, arg_max(value, freq) AS lv,
      max(freq) FILTER (freq < 360.5) AS f0, arg_max(value, freq) FILTER (freq < 360.5) AS v0,
      min(freq) FILTER (freq >= 360.5) AS f1, arg_min(value, freq) FILTER (freq >= 360.5) AS v1 FROM sweeps GROUP BY design_id),
    terms AS (SELECT design_id, ((f - 360.5) / 360.5) * ((f - 360.5) / 360.5) AS a,
      greatest(0.0, ((CASE WHEN 360.5 <= ff THEN fv WHEN 360.5 >= lf THEN lv ELSE v0 + (v1 - v0) * ((360.5 - f0) / (f1 - f0)) END) + 15.0) / 15.0) AS b,
      CASE WHEN design_id % 5 = 0 THEN 1.0 ELSE greatest(0.0, (6.0 - (design_id % 10)) / 6.0) END AS c FROM around)
    SELECT design_id, round(a, 6) AS frequency_loss, round(b, 6) AS matching_loss, round(c, 6)::DOUBLE AS gain_loss,
      round(5 * a + 3 * b + c, 6) AS loss FROM terms""")
def _(t):
    d = F.col("design_id")
    gains = t.targets().select("design_id", F.when(d % 5 != 0, (d % 10).cast("double")).alias("gain"))
    out = objectives.single_band_loss(t.sweeps(), gains, target_freq=360.5)
    return out.select("design_id", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


@register("frequency_distance_status", """SELECT trial_id, round(abs(objective - 2.4), 9) AS distance,
    CASE WHEN abs(objective - 2.4) > 0.5 THEN 'failed' WHEN abs(objective - 2.4) < 0.05 THEN 'success' ELSE 'completed' END AS outcome,
    round(CASE WHEN abs(objective - 2.4) > 0.5 THEN greatest(abs(objective - 2.4), 10.0) ELSE abs(objective - 2.4) END, 9) AS reported FROM trials""")
def _(t):
    out = objectives.frequency_distance_status(t.trials(), "objective", 2.4)
    return out.select("trial_id", rounded(F.col("distance"), 9).alias("distance"), "outcome", rounded(F.col("reported"), 9).alias("reported"))
