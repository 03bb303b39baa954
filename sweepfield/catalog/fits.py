"""Queries over fitted curves."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import TO_NEXT, r, ring
from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import fits

# Even outlines against the odd ones after them, in tens of units.
PAIRS = """a AS (SELECT contour_id // 2 AS pair_id, idx, x * 10 AS x, y * 10 AS y FROM contours WHERE contour_id % 2 = 0),
    b AS (SELECT contour_id // 2 AS pair_id, idx, x * 10 AS x, y * 10 AS y FROM contours WHERE contour_id % 2 = 1)"""
NEAR = PAIRS + """,
    na AS (SELECT a.pair_id, a.idx, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM a JOIN b ON a.pair_id = b.pair_id GROUP BY a.pair_id, a.idx),
    nb AS (SELECT b.pair_id, b.idx, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM a JOIN b ON a.pair_id = b.pair_id GROUP BY b.pair_id, b.idx),
    errs AS (SELECT *, (sa + sb) / 2 AS mse, (ma + mb) / 2 AS mae, greatest(xa, xb) AS h FROM (SELECT pair_id, avg(d) AS ma, avg(d * d) AS sa, max(d) AS xa FROM na GROUP BY pair_id)
      JOIN (SELECT pair_id, avg(d) AS mb, avg(d * d) AS sb, max(d) AS xb FROM nb GROUP BY pair_id) USING (pair_id))"""


def sides(t, scale=10):
    c = F.col
    rows = t.contours().select(
        "contour_id", F.expr("contour_id div 2").alias("pair_id"), "idx", (c("x") * scale).alias("x"), (c("y") * scale).alias("y")
    )
    return tuple(rows.filter(c("contour_id") % 2 == side).drop("contour_id") for side in (0, 1))


@register("nearest_distances", f"""WITH {NEAR} SELECT 'a' AS side, pair_id, idx, round(d, 6) AS distance FROM na UNION ALL SELECT 'b', pair_id, idx, round(d, 6) FROM nb""")
def _(t):
    a, b = sides(t)
    both = fits.nearest_distances(a, b).withColumn("side", F.lit("a")).unionByName(fits.nearest_distances(b, a).withColumn("side", F.lit("b")))
    return both.select("side", "pair_id", "idx", *r("distance"))


@register("fit_errors", f"WITH {NEAR} SELECT pair_id, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(h, 6) AS hausdorff FROM errs")
def _(t):
    return fits.fit_errors(*sides(t)).select("pair_id", *r("mse", "rmse", "mae", "hausdorff"))


@register("hausdorff", f"WITH {NEAR} SELECT pair_id, round(h, 6) AS hausdorff FROM errs")
def _(t):
    return fits.hausdorff(*sides(t)).select("pair_id", *r("hausdorff"))


MEASURED = f"""{ring()}, m AS (SELECT contour_id, count(*) AS n, sum(x * ny - nx * y) / 2 * 100 AS area, sum({TO_NEXT}) * 10 AS per,
      max({TO_NEXT}) FILTER (NOT is_last) * 10 AS gap, bool_or(is_last AND abs(nx - x) * 10 <= 1 + 1e-5 * abs(x * 10) AND abs(ny - y) * 10 <= 1 + 1e-5 * abs(y * 10)) AS closed FROM ring GROUP BY contour_id)"""


@register("area_perimeter_error", f"""WITH {MEASURED}, j AS (SELECT a.contour_id // 2 AS pair_id, abs(abs(a.area) - abs(b.area)) AS ea, abs(a.per - b.per) AS ep, abs(a.area) AS aa, a.per AS pa
      FROM m a JOIN m b ON b.contour_id = a.contour_id + 1 AND a.contour_id % 2 = 0)
    SELECT pair_id, round(ea, 5) AS area_error, round(ea / greatest(aa, 1.0), 5) AS area_relative, round(ep, 5) AS perimeter_error, round(ep / greatest(pa, 1.0), 5) AS perimeter_relative FROM j""")
def _(t):
    out = fits.area_perimeter_error(*sides(t), t.spans("contours"))
    return out.select("pair_id", *r("area_error", "area_relative", "perimeter_error", "perimeter_relative", digits=5))


HU = f"""{ring()}, e AS (SELECT contour_id, px * 10 AS p, py * 10 AS q, x * 10 AS x, y * 10 AS y, (px * y - x * py) * 100 AS a FROM ring),
    m AS (SELECT contour_id, sum(a) / 2 AS m00, sum(a * (p + x)) / 6 AS m10, sum(a * (q + y)) / 6 AS m01, sum(a * (p * p + p * x + x * x)) / 12 AS m20, sum(a * (q * q + q * y + y * y)) / 12 AS m02,
      sum(a * (p * (2 * q + y) + x * (q + 2 * y))) / 24 AS m11, sum(a * (p + x) * (p * p + x * x)) / 20 AS m30, sum(a * (q + y) * (q * q + y * y)) / 20 AS m03,
      sum(a * (p * p * (3 * q + y) + 2 * p * x * (q + y) + x * x * (q + 3 * y))) / 60 AS m21, sum(a * (q * q * (3 * p + x) + 2 * q * y * (p + x) + y * y * (p + 3 * x))) / 60 AS m12 FROM e GROUP BY contour_id),
    f AS (SELECT contour_id, m10 / m00 AS cx, m01 / m00 AS cy, sign(m00) * m00 AS m00, sign(m00) * m10 AS m10, sign(m00) * m01 AS m01, sign(m00) * m20 AS m20, sign(m00) * m02 AS m02, sign(m00) * m11 AS m11,
      sign(m00) * m30 AS m30, sign(m00) * m03 AS m03, sign(m00) * m21 AS m21, sign(m00) * m12 AS m12 FROM m),
    u AS (SELECT *, m20 - m10 * cx AS u20, m11 - m10 * cy AS u11, m02 - m01 * cy AS u02 FROM f),
    v AS (SELECT contour_id, u20 / m00 ** 2 AS v20, u11 / m00 ** 2 AS v11, u02 / m00 ** 2 AS v02, (m30 - cx * (3 * u20 + cx * m10)) / (m00 ** 2.5) AS v30,
      (m21 - cx * (2 * u11 + cx * m01) - cy * u20) / (m00 ** 2.5) AS v21, (m12 - cy * (2 * u11 + cy * m10) - cx * u02) / (m00 ** 2.5) AS v12, (m03 - cy * (3 * u02 + cy * m01)) / (m00 ** 2.5) AS v03 FROM u),
    k AS (SELECT contour_id, v30 + v12 AS p, v21 + v03 AS q, v20 - v02 AS d, v30 - 3 * v12 AS r, 3 * v21 - v03 AS s, v20 + v02 AS t, v11 FROM v),
    h AS (SELECT contour_id, list_transform([t, d * d + 4 * v11 * v11, r * r + s * s, p * p + q * q, r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q), d * (p * p - q * q) + 4 * v11 * p * q,
      s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q)], lambda z: -sign(z) * log10(abs(z) + 1e-10)) AS hu FROM k)"""


@register("shape_similarity", f"""WITH {HU} SELECT a.contour_id // 2 AS pair_id, round(1.0 / (1.0 + list_distance(a.hu, b.hu)), 4) AS similarity
    FROM h a JOIN h b ON b.contour_id = a.contour_id + 1 AND a.contour_id % 2 = 0""")
def _(t):
    return fits.shape_similarity(*sides(t), t.spans("contours")).select("pair_id", *r("similarity", digits=4))


@register("keypoint_error", f"""WITH {PAIRS}, e AS (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b),
    k AS (SELECT s, pair_id, unnest([arg_min(x, (x, idx)), arg_max(x, (x, -idx)), arg_min(x, (y, idx)), arg_max(x, (y, -idx))]) AS x,
      unnest([arg_min(y, (x, idx)), arg_max(y, (x, -idx)), arg_min(y, (y, idx)), arg_max(y, (y, -idx))]) AS y, unnest([1, 2, 3, 4]) AS i FROM e GROUP BY s, pair_id),
    d AS (SELECT p.pair_id, p.i, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM k p JOIN k q ON p.pair_id = q.pair_id AND p.s = 0 AND q.s = 1 GROUP BY p.pair_id, p.i)
    SELECT pair_id, round(avg(d), 6) AS mean_error, round(max(d), 6) AS max_error FROM d GROUP BY pair_id""")
def _(t):
    return fits.keypoint_error(*sides(t)).select("pair_id", *r("mean_error", "max_error"))


@register("topology_consistency", f"""WITH {MEASURED},
    es AS (SELECT r.contour_id, idx, r.n, closed, x * 10 AS ax, y * 10 AS ay, nx * 10 AS bx, ny * 10 AS b_y, is_last FROM ring r JOIN m ON r.contour_id = m.contour_id WHERE r.contour_id % 2 = 1),
    rings AS (SELECT contour_id, idx, closed, CASE WHEN closed THEN n - 1 ELSE n END AS n, ax, ay, CASE WHEN closed AND idx = n - 2 THEN first_value(ax) OVER w ELSE bx END AS bx,
      CASE WHEN closed AND idx = n - 2 THEN first_value(ay) OVER w ELSE b_y END AS b_y FROM es WHERE NOT is_last WINDOW w AS (PARTITION BY contour_id ORDER BY idx)),
    o AS (SELECT i.contour_id, (i.bx - i.ax) * (j.ay - i.ay) - (i.b_y - i.ay) * (j.ax - i.ax) AS o1, (i.bx - i.ax) * (j.b_y - i.ay) - (i.b_y - i.ay) * (j.bx - i.ax) AS o2,
      (j.bx - j.ax) * (i.ay - j.ay) - (j.b_y - j.ay) * (i.ax - j.ax) AS o3, (j.bx - j.ax) * (i.b_y - j.ay) - (j.b_y - j.ay) * (i.bx - j.ax) AS o4
      FROM rings i JOIN rings j ON i.contour_id = j.contour_id AND j.idx > i.idx + 1 AND NOT (i.closed AND i.idx = 0 AND j.idx = j.n - 1)),
    crossed AS (SELECT DISTINCT contour_id FROM o WHERE least(abs(o1), abs(o2), abs(o3), abs(o4)) > 1e-12 AND o1 * o2 < 0 AND o3 * o4 < 0)
    SELECT a.contour_id // 2 AS pair_id, a.closed = b.closed AS closed_consistent, b.closed AS closed, b.gap < 10 AS connected, c.contour_id IS NOT NULL AS self_crossing,
      sign(a.area) = sign(b.area) AS orientation_consistent FROM m a JOIN m b ON b.contour_id = a.contour_id + 1 AND a.contour_id % 2 = 0 LEFT JOIN crossed c ON b.contour_id = c.contour_id""")
def _(t):
    return fits.topology_consistency(*sides(t), t.spans("contours"))


@register("primitive_mix", """WITH p AS (SELECT design_id, CASE type WHEN 'spline' THEN 'bspline' ELSE type END AS type, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, CASE WHEN idx % 3 = 0 THEN abs(x1) END AS err FROM primitives)
    SELECT design_id, count(*) AS primitive_count, round(sum(len) FILTER (type = 'line') / sum(len), 6) AS line_ratio, round(sum(len) FILTER (type = 'arc') / sum(len), 6) AS arc_ratio,
      round(sum(len) FILTER (type = 'bspline') / sum(len), 6) AS spline_ratio, round(avg(err), 6) AS mean_error, round(max(err), 6) AS max_error FROM p GROUP BY design_id""")
def _(t):
    c = F.col
    rows = t.primitives().select(
        "design_id", F.when(c("type") == "spline", "bspline").otherwise(c("type")).alias("type"),
        F.hypot(c("x2") - c("x1"), c("y2") - c("y1")).alias("length"), F.when(c("idx") % 3 == 0, F.abs("x1")).alias("error"),
    )
    return fits.primitive_mix(rows).select("design_id", "primitive_count", *r("line_ratio", "arc_ratio", "spline_ratio", "mean_error", "max_error"))


@register("overall_score", f"""WITH {NEAR}, g AS (SELECT pair_id, sqrt(mse) AS rmse, pair_id % 2 = 0 AS c1, pair_id % 3 = 0 AS c2, pair_id % 5 = 0 AS c3, pair_id % 7 = 0 AS c4, CASE WHEN pair_id % 4 <> 0 THEN h END AS err, CASE WHEN pair_id % 6 <> 0 THEN mae * 10 END AS reg FROM errs),
    s AS (SELECT pair_id, greatest(0.0, 100 - least(rmse * 10, 100)) AS g, 100.0::DOUBLE - CASE WHEN c1 THEN 0 ELSE 20 END - CASE WHEN c2 THEN 0 ELSE 30 END - CASE WHEN c3 THEN 25 ELSE 0 END - CASE WHEN c4 THEN 0 ELSE 10 END AS t,
      coalesce(greatest(0.0, 100 - least(err * 20, 100)), 100.0) AS m, coalesce(reg, 50.0) AS e FROM g)
    SELECT pair_id, round(g, 5) AS geometric, round(t, 5) AS topology, round(m, 5) AS semantic, round(e, 5) AS engineering, round(0.4 * g + 0.3 * t + 0.2 * m + 0.1 * e, 5) AS overall FROM s""")
def _(t):
    c, k = F.col, F.col("pair_id")
    scores = fits.overall_score(
        c("rmse"), k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0, F.when(k % 4 != 0, c("hausdorff")), F.when(k % 6 != 0, c("mae") * 10)
    )
    return fits.fit_errors(*sides(t)).select("pair_id", *[rounded(s, 5).alias(name) for name, s in scores.items()])


SEGS = """segs AS (SELECT run_id AS sample_id, evaluation AS idx, trial_id % 40 AS samples, ['line', ' Circle', 'bspline', 'Curve', 'blob'][1 + trial_id % 5] AS type, trial_id % 31 AS ctrl, status FROM trials)"""
BOUNDS = SEGS + """, bounds AS (SELECT sample_id, idx, (sum(greatest(1, samples)) OVER (PARTITION BY sample_id ORDER BY idx) - greatest(1, samples))::DOUBLE
      / sum(greatest(1, samples)) OVER (PARTITION BY sample_id) AS boundary, status FROM segs)"""


def segs(t):
    k = F.col("trial_id")
    names = F.array(*[F.lit(n) for n in ("line", " Circle", "bspline", "Curve", "blob")])
    return t.trials().select(
        F.col("run_id").alias("sample_id"), F.col("evaluation").alias("idx"), (k % 40).alias("samples"),
        F.element_at(names, (k % 5 + 1).cast("int")).alias("type"), (k % 31).alias("ctrl"), "status",
    )


@register("boundary_ratios", f"WITH {BOUNDS} SELECT sample_id, idx, round(boundary, 6) AS boundary FROM bounds")
def _(t):
    return fits.boundary_ratios(segs(t), spans=t.spans("trials")).select("sample_id", "idx", *r("boundary"))


MAE = BOUNDS + """, mae AS (SELECT sample_id, avg(d) AS mae FROM (SELECT g.sample_id, g.idx, min(abs(g.boundary - p.boundary)) AS d FROM bounds g JOIN bounds p ON g.sample_id = p.sample_id AND g.status = 'completed' AND p.status = 'failed' GROUP BY g.sample_id, g.idx) GROUP BY sample_id),
    n AS (SELECT sample_id, count(*) FILTER (status = 'completed') AS g, count(*) FILTER (status = 'failed') AS p FROM bounds GROUP BY sample_id),
    breaks AS (SELECT n.sample_id, CASE WHEN g = 0 OR p = 0 THEN 1.0 ELSE mae END AS breakpoint_mae, abs(g - p) AS count_error FROM n LEFT JOIN mae ON n.sample_id = mae.sample_id)"""


def breaks(t):
    bounds = fits.boundary_ratios(segs(t), spans=t.spans("trials")).join(segs(t).select("sample_id", "idx", "status"), ["sample_id", "idx"])
    pick = lambda s: bounds.filter(F.col("status") == s).select("sample_id", "boundary")
    return fits.breakpoint_mae(pick("completed"), pick("failed"))


@register("breakpoint_mae", f"WITH {MAE} SELECT sample_id, round(breakpoint_mae, 6) AS breakpoint_mae, count_error FROM breaks")
def _(t):
    return breaks(t).select("sample_id", *r("breakpoint_mae"), "count_error")


@register("map_type", f"""WITH {SEGS} SELECT sample_id, idx, CASE trim(lower(type)) WHEN 'arc' THEN 'arc' WHEN 'circle' THEN 'arc' WHEN 'bspline' THEN 'spline' WHEN 'spline' THEN 'spline' WHEN 'curve' THEN 'spline' ELSE trim(lower(type)) END AS kind FROM segs""")
def _(t):
    return segs(t).select("sample_id", "idx", fits.map_type(F.col("type")).alias("kind"))


PARAMS = """, params AS (SELECT sample_id, status, CASE trim(lower(type)) WHEN 'line' THEN 1 WHEN 'circle' THEN 2 WHEN 'blob' THEN 3 ELSE greatest(4, least(24, CASE WHEN ctrl > 0 THEN ctrl ELSE 4 END)) END AS k FROM segs),
    eff AS (SELECT sample_id, greatest(1, coalesce(sum(k) FILTER (status = 'completed'), 0))::BIGINT AS truth, greatest(1, coalesce(sum(k) FILTER (status = 'failed'), 0))::BIGINT AS guess FROM params GROUP BY sample_id),
    pars AS (SELECT *, CASE WHEN guess <= truth THEN 1.0 ELSE greatest(0.0, 1.0 - least(1.0, 0.32 * ((guess - truth)::DOUBLE / greatest(1, truth)))) END AS p FROM eff)"""


def params(t):
    k = fits.effective_params(fits.map_type(F.col("type")), F.col("ctrl"))
    side = lambda s: F.greatest(F.lit(1), F.coalesce(F.sum(F.when(F.col("status") == s, k)), F.lit(0))).cast("long")
    out = segs(t).groupBy("sample_id").agg(side("completed").alias("truth"), side("failed").alias("guess"))
    return out.withColumn("parsimony", fits.parsimony_score(F.col("guess"), F.col("truth")))


@register("parsimony_score", f"WITH {SEGS}{PARAMS} SELECT sample_id, truth, guess, round(p, 6)::DOUBLE AS parsimony FROM pars")
def _(t):
    return params(t).select("sample_id", "truth", "guess", *r("parsimony"))


SAMPLES = MAE + PARAMS + """, samples AS (SELECT b.sample_id, breakpoint_mae, count_error, (b.sample_id % 11)::DOUBLE / 10 AS type_score, truth, guess, p, b.sample_id % 9 <> 0 AS success,
    0.52 * greatest(0.0, 1.0 - least(1.0, breakpoint_mae / 0.08) - least(0.4, 0.06 * count_error)) + 0.30 * ((b.sample_id % 11)::DOUBLE / 10) + 0.18 * p AS score FROM breaks b JOIN pars q ON b.sample_id = q.sample_id)"""


def samples(t):
    k = F.col("sample_id")
    rows = breaks(t).join(params(t), "sample_id").select("*", ((k % 11).cast("double") / 10).alias("type_score"), (k % 9 != 0).alias("success"))
    return rows.withColumn("param_score", fits.param_score("breakpoint_mae", "count_error", "type_score", "parsimony"))


@register("param_score", f"WITH {SAMPLES} SELECT sample_id, round(score, 6) AS param_score FROM samples")
def _(t):
    return samples(t).select("sample_id", *r("param_score"))


@register("dataset_report", f"""WITH {SAMPLES} SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
    round(avg(breakpoint_mae) FILTER (success), 6) AS breakpoint_mae_mean, round(avg(count_error) FILTER (success), 6) AS count_error_mean, round(avg(type_score) FILTER (success), 6) AS type_score_mean,
    round(avg(truth) FILTER (success), 6) AS effective_params_truth_mean, round(avg(guess) FILTER (success), 6) AS effective_params_predicted_mean, round(avg(p) FILTER (success), 6) AS parsimony_mean,
    round(avg(score) FILTER (success), 6) AS param_score_mean FROM samples""")
def _(t):
    rows = samples(t).withColumnsRenamed({"truth": "effective_params_truth", "guess": "effective_params_predicted"})
    return fits.dataset_report(rows).select("total", "success", "failed", *r(*[f"{n}_mean" for n in fits.REPORT_MEANS]))


@register("main_contour", f"""WITH {SEGS} SELECT sample_id, arg_max(idx, (samples, -idx)) AS idx, max(samples) AS samples FROM segs GROUP BY sample_id""")
def _(t):
    return fits.main_contour(segs(t).select("sample_id", "idx", "samples"))


# The table of the textbook, one row per step: a row is the running maximum of what stands above it and its matches.
@register("lcs_ratio", f"""WITH RECURSIVE {SEGS}, lists AS (SELECT sample_id, coalesce(list(type ORDER BY idx, type) FILTER (status = 'completed'), []) AS a, coalesce(list(type ORDER BY idx, type) FILTER (status = 'failed'), []) AS b FROM segs GROUP BY sample_id),
    walk AS (SELECT sample_id, a, b, 0::BIGINT AS i, [0::BIGINT FOR v IN b] AS best FROM lists
      UNION ALL SELECT sample_id, a, b, i + 1, [list_max(found[1:j]) FOR j IN range(1, len(b) + 1)]
      FROM (SELECT *, [greatest(best[j], CASE WHEN a[i + 1] = b[j] THEN 1 + CASE WHEN j > 1 THEN best[j - 1] ELSE 0 END ELSE 0 END) FOR j IN range(1, len(b) + 1)] AS found FROM walk WHERE i < len(a)))
    SELECT sample_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(best[len(b)]::DOUBLE / greatest(len(a), len(b)), 6) END AS lcs FROM walk WHERE i = len(a)""")
def _(t):
    rows = segs(t).groupBy("sample_id").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("idx", "type")))), lambda v: v["type"]).alias(s) for s in ("completed", "failed")]
    )
    return rows.select("sample_id", rounded(fits.lcs_ratio("completed", "failed")).alias("lcs"))


@register("level_report", """WITH c AS (SELECT p_partkey AS idx, p_size % 6 AS level, p_retailprice > 950 AS passed FROM part)
    SELECT level::BIGINT AS level, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed)::DOUBLE / count(*) * 100, 6) AS pass_rate FROM c GROUP BY level""")
def _(t):
    rows = t.table("part").select(F.col("p_partkey").alias("idx"), (F.col("p_size") % 6).cast("long").alias("level"), (F.col("p_retailprice") > 950).alias("passed"))
    return fits.level_report(rows).select("level", "total", "passed", "failed", *r("pass_rate"))


