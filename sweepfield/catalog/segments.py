"""Queries over segmentation of ordered points."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import r
from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import segments

# One track per part: an uneven line followed by an arc of the part's size.
TRACKS = """tracks AS (SELECT p_partkey AS contour_id, i AS idx, CASE WHEN i < 18 THEN i * 3.0::DOUBLE ELSE 54 + (p_size + 5) * sin((i - 18) * 0.15::DOUBLE) END AS x,
    CASE WHEN i < 18 THEN ((i * i * 7 + p_partkey * 3) % 5) * 0.3::DOUBLE * (p_partkey % 3) ELSE (p_size + 5) * (1 - cos((i - 18) * 0.15::DOUBLE)) END AS y FROM part, (SELECT unnest(range(0, 48)) AS i)),
    w AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tracks WINDOW w AS (PARTITION BY contour_id ORDER BY idx)),
    k0 AS (SELECT *, CASE WHEN px IS NOT NULL AND nx IS NOT NULL THEN acos(greatest(-1.0, least(1.0, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) + 1e-8)))) END AS bend FROM w),
    curved AS (SELECT contour_id, idx, x, y, coalesce(bend, lead(bend) OVER w, lag(bend) OVER w, 0.0) AS k FROM k0 WINDOW w AS (PARTITION BY contour_id ORDER BY idx))"""
CUTS = TRACKS + """, cuts AS (SELECT *, coalesce(abs(k - lag(k) OVER w) > 0.15, false) AS cut FROM curved WINDOW w AS (PARTITION BY contour_id ORDER BY idx))"""
SPLIT = CUTS + """,
    nums AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY contour_id ORDER BY idx) AS s FROM cuts),
    segs AS (SELECT contour_id, idx, x, y, s::BIGINT AS segment FROM nums UNION ALL SELECT contour_id, idx, x, y, s::BIGINT - 1 FROM nums WHERE cut)"""
SEGW = """sw AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(x, 2) OVER w AS nx2, lead(y, 2) OVER w AS ny2 FROM segs WINDOW w AS (PARTITION BY contour_id, segment ORDER BY idx))"""


def tracks(t):
    i, key, size = F.col("idx"), F.col("p_partkey"), F.col("p_size") + 5
    turn = (i - 18) * F.lit(0.15)
    rows = t.table("part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("idx"))
    return rows.select(
        key.alias("contour_id"), i.cast("long").alias("idx"), F.when(i < 18, i * F.lit(3.0)).otherwise(54 + size * F.sin(turn)).alias("x"),
        F.when(i < 18, ((i * i * 7 + key * 3) % 5) * F.lit(0.3) * (key % 3)).otherwise(size * (1 - F.cos(turn))).alias("y"),
    )


def spans(t):
    return t.measured("tracks", tracks(t), ["contour_id"], "idx")


def split(t):
    return segments.split_on_curvature(tracks(t), spans=spans(t))


@register("discrete_curvature", f"WITH {TRACKS} SELECT contour_id, idx, round(k, 5) AS curvature FROM curved")
def _(t):
    return segments.discrete_curvature(tracks(t), spans(t)).select("contour_id", "idx", *r("curvature", digits=5))


@register("split_on_curvature", f"WITH {SPLIT} SELECT contour_id, idx, segment FROM segs")
def _(t):
    return split(t).select("contour_id", "idx", "segment")


# Cuts at least nine points apart, the last one dropped when it leaves a short tail.
MIN_SPLIT = CUTS + """, n AS (SELECT contour_id, max(idx) + 1 AS n FROM tracks GROUP BY contour_id),
    ks AS (SELECT contour_id, list(idx ORDER BY idx) AS ks FROM cuts WHERE cut GROUP BY contour_id),
    walk AS (SELECT contour_id, 0::BIGINT AS pos, ks FROM ks UNION ALL SELECT contour_id, list_filter(ks, lambda k: k >= pos + 9)[1], ks FROM walk WHERE len(list_filter(ks, lambda k: k >= pos + 9)) > 0),
    kept AS (SELECT w.contour_id, pos FROM walk w WHERE pos > 0),
    last AS (SELECT contour_id, max(pos) AS pos FROM kept GROUP BY contour_id),
    fin AS (SELECT k.* FROM kept k JOIN n ON k.contour_id = n.contour_id JOIN last l ON k.contour_id = l.contour_id WHERE NOT (k.pos = l.pos AND n.n - k.pos < 10)),
    mark AS (SELECT t.contour_id, t.idx, t.x, t.y, f.pos IS NOT NULL AS cut, sum((f.pos IS NOT NULL)::INTEGER) OVER (PARTITION BY t.contour_id ORDER BY t.idx) AS s FROM tracks t LEFT JOIN fin f ON t.contour_id = f.contour_id AND t.idx = f.pos),
    segs AS (SELECT contour_id, idx, x, y, s::BIGINT AS segment FROM mark UNION ALL SELECT contour_id, idx, x, y, s::BIGINT - 1 FROM mark WHERE cut)"""


@register("split_min_points", f"WITH RECURSIVE {MIN_SPLIT} SELECT contour_id, idx, segment FROM segs")
def _(t):
    return segments.split_min_points(tracks(t), spans=spans(t)).select("contour_id", "idx", "segment")


CHORD = f"""{SPLIT}, ends AS (SELECT contour_id, segment, count(*) AS n, arg_min(x, idx) AS ax, arg_min(y, idx) AS ay, arg_max(x, idx) AS bx, arg_max(y, idx) AS b_y FROM segs GROUP BY contour_id, segment),
    chord AS (SELECT s.contour_id, s.segment, any_value(n) AS n, max(CASE WHEN sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) >= 1e-6 THEN abs((bx - ax) * (y - ay) - (b_y - ay) * (x - ax)) / sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) ELSE 0.0 END) AS e,
      any_value(sqrt((bx - ax) ** 2 + (b_y - ay) ** 2)) AS c FROM segs s JOIN ends e ON s.contour_id = e.contour_id AND s.segment = e.segment GROUP BY s.contour_id, s.segment)"""


@register("line_fit_chord", f"WITH {CHORD} SELECT contour_id, segment, n, CASE WHEN n < 2 THEN -1.0 ELSE round(e, 6) END + 0.0 AS line_error, round(c, 6) AS chord FROM chord")
def _(t):
    # A segment of one point has no line; its infinite error shows as -1.
    out = segments.line_fit_chord(split(t))
    error = F.when(F.col("n") < 2, -1.0).otherwise(rounded(F.col("line_error")))
    return out.select("contour_id", "segment", "n", error.alias("line_error"), *r("chord"))


PCA = f"""{SPLIT}, {SEGW}, mo AS (SELECT contour_id, segment, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM segs GROUP BY contour_id, segment),
    ax AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS l0, greatest(0.0, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy ** 2)) AS l1, atan2(2 * xy, xx - yy) / 2 AS th FROM mo),
    re AS (SELECT a.contour_id, a.segment, any_value(n) AS n, any_value(l0) AS l0, any_value(l1) AS l1, max(abs((y - my) * cos(th) - (x - mx) * sin(th))) AS res,
      degrees(coalesce(sum(acos(greatest(-1.0, least(1.0, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) + 1e-8))))) FILTER (px IS NOT NULL AND nx IS NOT NULL), 0)) AS turn
      FROM sw s JOIN ax a ON s.contour_id = a.contour_id AND s.segment = a.segment GROUP BY a.contour_id, a.segment),
    lin AS (SELECT contour_id, segment, n, CASE WHEN n = 2 THEN 0.0 ELSE sqrt(l1 * n) / (sqrt(l0 * n) + 1e-9) END AS q, CASE WHEN n = 2 THEN 0.0 ELSE res END AS res, turn, n = 2 OR (n > 2 AND sqrt(l0 * n) >= 1e-9
      AND sqrt(l1 * n) / (sqrt(l0 * n) + 1e-9) < 0.02 AND res < 1.0 AND turn < 10) AS is_line FROM re)"""


@register("line_fit_pca", f"WITH {PCA} SELECT contour_id, segment, n, round(q, 4) + 0.0 AS linearity, round(res, 5) + 0.0 AS max_residual, round(turn, 3) + 0.0 AS total_turn, is_line FROM lin")
def _(t):
    out = segments.line_fit_pca(split(t), spans=spans(t))
    return out.select("contour_id", "segment", "n", *r("linearity", digits=4), *r("max_residual", digits=5), *r("total_turn", digits=3), "is_line")


CIRCLE = """mn AS (SELECT contour_id, segment, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM segs GROUP BY contour_id, segment),
    su AS (SELECT s.contour_id, s.segment, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) ** 2) AS uu, sum((x - mx) * (y - my)) AS uv, sum((y - my) ** 2) AS vv,
      sum((x - mx) * ((x - mx) ** 2 + (y - my) ** 2)) / 2 AS p, sum((y - my) * ((x - mx) ** 2 + (y - my) ** 2)) / 2 AS q FROM segs s JOIN mn m ON s.contour_id = m.contour_id AND s.segment = m.segment GROUP BY s.contour_id, s.segment),
    ci AS (SELECT contour_id, segment, n, abs(uu * vv - uv * uv) > 1e-12 * greatest(uu * vv, 1e-300) AS ok, mx, my, mx + (p * vv - q * uv) / (uu * vv - uv * uv) AS cx, my + (q * uu - p * uv) / (uu * vv - uv * uv) AS cy FROM su)"""
FIT = f"""{SPLIT}, {SEGW}, {CIRCLE},
    di AS (SELECT s.*, n, cx, cy, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d, acos(greatest(-1.0, least(1.0, ((x - cx) * (px - cx) + (y - cy) * (py - cy)) / (sqrt((x - cx) ** 2 + (y - cy) ** 2) * sqrt((px - cx) ** 2 + (py - cy) ** 2))))) AS a
      FROM sw s JOIN ci c ON s.contour_id = c.contour_id AND s.segment = c.segment WHERE n >= 3 AND ok),
    fit AS (SELECT contour_id, segment, any_value(cx) AS cx, any_value(cy) AS cy, sqrt(avg(d * d)) AS radius, stddev_pop(d) AS sd, min(d) AS lo, max(d) AS hi, coalesce(stddev_pop(a) FILTER (px IS NOT NULL), 0) AS sn FROM di GROUP BY contour_id, segment),
    arc AS (SELECT *, CASE WHEN sd / (radius + 1e-9) <= 0.05 AND sn <= 0.1 THEN greatest(abs(hi - radius), abs(lo - radius)) ELSE 'inf'::DOUBLE END AS e FROM fit)"""


@register("circle_fit", f"""WITH {FIT} SELECT contour_id, segment, CASE WHEN radius < 1e4 THEN round(cx, 3) + 0.0 END AS cx, CASE WHEN radius < 1e4 THEN round(cy, 3) + 0.0 END AS cy,
    CASE WHEN radius < 1e4 THEN round(radius, 3) END AS radius, CASE WHEN NOT coalesce(radius < 1e4, false) THEN NULL WHEN isinf(e) THEN -1.0 ELSE round(e, 4) END + 0.0 AS arc_error FROM arc""")
def _(t):
    # Circles that are straight to within rounding are shown without figures.
    out = segments.circle_fit(split(t), spans=spans(t))
    bent = F.col("radius") < 1e4
    error = F.when(F.col("arc_error") == float("inf"), -1.0).otherwise(rounded(F.col("arc_error"), 4))
    return out.select(
        "contour_id", "segment", *[F.when(bent, rounded(F.col(n), 3)).alias(n) for n in ("cx", "cy", "radius")], F.when(bent, error).alias("arc_error"))


@register("classify_segments", f"""WITH {FIT}, {CHORD[len(SPLIT) + 2:]}
    SELECT c.contour_id, c.segment, CASE WHEN c.e < 2 THEN 'line' WHEN a.e < 2 THEN 'arc' ELSE 'spline' END AS type, round(CASE WHEN NOT c.e < 2 AND a.e < 2 THEN radius END, 3) AS radius
    FROM chord c LEFT JOIN arc a ON c.contour_id = a.contour_id AND c.segment = a.segment WHERE n >= 2 AND NOT (c.e < 2 AND c.c < 8) AND NOT (c.e >= 2 AND coalesce(a.e < 2, false) AND radius < 3)""")
def _(t):
    return segments.classify_segments(split(t), spans(t)).select("contour_id", "segment", "type", *r("radius", digits=3))


@register("drop_short_segments", f"""WITH {SPLIT}, {SEGW}, l AS (SELECT contour_id, segment, coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 0.0) AS length FROM sw GROUP BY contour_id, segment)
    SELECT contour_id, segment, round(length, 5) AS length FROM l WHERE length >= 8.0""")
def _(t):
    return segments.drop_short_segments(split(t), spans=spans(t)).select("contour_id", "segment", *r("length", digits=5))


# Sums over each full window of up to five points, by joining positions.
ARC = f"""{CIRCLE},
    ar AS (SELECT s.*, c.n, CASE WHEN ok THEN c.cx ELSE c.mx END AS cx, CASE WHEN ok THEN c.cy ELSE c.my END AS cy, least(5, c.n // 2) AS size, row_number() OVER (PARTITION BY s.contour_id, s.segment ORDER BY idx) AS p
      FROM segs s JOIN ci c ON s.contour_id = c.contour_id AND s.segment = c.segment WHERE c.n >= 6),
    wm AS (SELECT a.contour_id, a.segment, a.p, a.size, avg(b.x) AS mx, avg(b.y) AS my FROM ar a JOIN ar b ON a.contour_id = b.contour_id AND a.segment = b.segment AND b.p BETWEEN a.p AND a.p + a.size - 1
      WHERE a.p + a.size - 1 <= a.n GROUP BY ALL),
    ws AS (SELECT a.contour_id, a.segment, a.p, a.mx, a.my, sum((b.x - a.mx) ** 2) AS uu, sum((b.x - a.mx) * (b.y - a.my)) AS uv, sum((b.y - a.my) ** 2) AS vv,
      sum((b.x - a.mx) * ((b.x - a.mx) ** 2 + (b.y - a.my) ** 2)) / 2 AS p3, sum((b.y - a.my) * ((b.x - a.mx) ** 2 + (b.y - a.my) ** 2)) / 2 AS q3
      FROM wm a JOIN ar b ON a.contour_id = b.contour_id AND a.segment = b.segment AND b.p BETWEEN a.p AND a.p + a.size - 1 GROUP BY ALL),
    wc AS (SELECT contour_id, segment, mx + CASE WHEN flat THEN 0 ELSE (p3 * vv - q3 * uv) / (uu * vv - uv * uv) END AS x, my + CASE WHEN flat THEN 0 ELSE (q3 * uu - p3 * uv) / (uu * vv - uv * uv) END AS y
      FROM (SELECT *, abs(uu * vv - uv * uv) <= 1e-24 * (uu + vv) ** 2 AS flat FROM ws)),
    dr AS (SELECT contour_id, segment, CASE WHEN count(*) < 3 THEN 0.0 ELSE greatest(stddev_pop(x), stddev_pop(y)) END AS sigma_c FROM wc GROUP BY contour_id, segment),
    tn AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d, atan2(y - cy, x - cx) - atan2(lag(y) OVER w - cy, lag(x) OVER w - cx) AS t,
      sign((lead(x) OVER w - x) * (lead(y, 2) OVER w - lead(y) OVER w) - (lead(y) OVER w - y) * (lead(x, 2) OVER w - lead(x) OVER w)) AS side FROM ar WINDOW w AS (PARTITION BY contour_id, segment ORDER BY idx)),
    an AS (SELECT *, sum(coalesce(CASE WHEN t >= pi() AND t - 2 * pi() = -pi() THEN pi() WHEN t >= pi() THEN t - 2 * pi() WHEN t < -pi() THEN t + 2 * pi() ELSE t END, 0.0)) OVER (PARTITION BY contour_id, segment ORDER BY idx) AS angle FROM tn),
    aq AS (SELECT a.contour_id, a.segment, any_value(n) AS n, avg(d) AS radius, stddev_pop(d) / (avg(d) + 1e-9) AS sigma_r, any_value(sigma_c) AS sigma_c, degrees(max(angle) - min(angle)) AS angle_span,
      coalesce(avg((side > 0)::INTEGER) > 0.3 AND avg((side < 0)::INTEGER) > 0.3, false) AS mixed FROM an a JOIN dr ON a.contour_id = dr.contour_id AND a.segment = dr.segment GROUP BY a.contour_id, a.segment)"""


@register("arc_quality", f"""WITH RECURSIVE {MIN_SPLIT}, {ARC} SELECT contour_id, segment, n, round(radius, 3) + 0.0 AS radius, round(sigma_r, 4) + 0.0 AS sigma_r, round(sigma_c, 4) + 0.0 AS sigma_c, round(angle_span, 4) + 0.0 AS angle_span,
    sigma_r <= 0.02 AND sigma_c <= 1.0 AND angle_span >= 15 AND NOT mixed AS is_arc FROM aq""")
def _(t):
    rows = segments.split_min_points(tracks(t), spans=spans(t))
    return segments.arc_quality(rows, spans=spans(t)).select("contour_id", "segment", "n", *r("radius", digits=3), *r("sigma_r", "sigma_c", "angle_span", digits=4), "is_arc")


@register("segment_decision", f"""WITH RECURSIVE {MIN_SPLIT}, {PCA[len(SPLIT) + 2:]}, {ARC} SELECT l.contour_id, l.segment, CASE WHEN l.is_line THEN 'line'
    WHEN coalesce(sigma_r < 0.02 AND sigma_c <= 1.0 AND angle_span > 20 AND NOT mixed AND l.n >= 8, false) THEN 'arc' ELSE 'spline' END AS decision
    FROM lin l LEFT JOIN aq a ON l.contour_id = a.contour_id AND l.segment = a.segment""")
def _(t):
    return segments.segment_decision(segments.split_min_points(tracks(t), spans=spans(t)), spans=spans(t))


def typed(t):
    rows = split(t)
    kinds = segments.classify_segments(rows, spans(t)).select("contour_id", "segment", "type", F.col("line_error").alias("error"))
    return rows.join(kinds, ["contour_id", "segment"])


@register("merge_adjacent")
def _(t):
    out = segments.merge_adjacent(typed(t).drop("error"), spans(t))
    return out.groupBy("contour_id", "segment", "type").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


@register("merge_greedy")
def _(t):
    out = segments.merge_greedy(typed(t), cap=6, spans=spans(t))
    return out.groupBy("contour_id", "segment", "type").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
