"""Queries over validation reports."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import CROSS, DOT, INNER, LA, LB, TO_NEXT, HEADING, crossing_sql, path, r, ring
from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import contours, validate

# Twelve-gons, half of them closed by a repeated point, some twisted, some not flat.
LOOPS = """loop_points AS (SELECT contour_id, idx, CASE WHEN contour_id % 5 = 0 AND idx = 3 THEN -9.0 - x ELSE x END AS x,
      y, CASE WHEN contour_id % 3 = 0 THEN idx * 0.001 ELSE 0.0 END::DOUBLE AS z
    FROM (SELECT contour_id, idx, x, y FROM circles
      UNION ALL SELECT contour_id, 12, x, y FROM circles WHERE idx = 0 AND contour_id % 2 = 0)),
    loops AS (SELECT p_partkey AS contour_id, p_partkey // 3 AS design_id, p_partkey % 4 <> 1 AS closed FROM part)"""


def loop_points(t):
    c, i = F.col("contour_id"), F.col("idx")
    rows = t.circles()
    extra = rows.filter((i == 0) & (c % 2 == 0)).withColumn("idx", F.lit(12).cast("long"))
    points = rows.unionByName(extra).select(
        "contour_id", "idx", F.when((c % 5 == 0) & (i == 3), -9.0 - F.col("x")).otherwise(F.col("x")).alias("x"), "y",
        F.when(c % 3 == 0, i * 0.001).otherwise(0.0).alias("z"),
    )
    loops = t.table("part").select(
        F.col("p_partkey").alias("contour_id"), F.expr("p_partkey div 3").alias("design_id"), (F.col("p_partkey") % 4 != 1).alias("closed")
    )
    return points, loops


def broken_loops(t):
    return t.table("part").select(F.col("p_partkey").alias("contour_id")).filter(F.col("contour_id") % 6 == 0)


REPORT = f"""{LOOPS}, {crossing_sql('proper').replace('FROM contours', 'FROM loop_points')},
    zs AS (SELECT contour_id, idx, z, lead(z) OVER (PARTITION BY contour_id ORDER BY idx) AS nz, first_value(z) OVER (PARTITION BY contour_id ORDER BY idx) AS z0 FROM loop_points),
    m AS (SELECT r.contour_id, count(*) AS point_count, max({TO_NEXT}) FILTER (is_last) AS gap, max(abs(z - z0)) AS dz,
      min({TO_NEXT}) FILTER (NOT is_last) AS oe, max({TO_NEXT}) FILTER (is_last AND {TO_NEXT} > 1e-12) AS ce, abs(sum(x * ny - nx * y) / 2) AS area,
      count(*) FILTER (NOT is_last AND sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2) <= 1e-9) AS dup
      FROM ring r JOIN zs ON r.contour_id = zs.contour_id AND r.idx = zs.idx GROUP BY r.contour_id),
    rep AS (SELECT design_id, m.contour_id, gap, gap < 1e-6 AS is_closed, dz, dz < 1e-9 AS planar, coalesce(c, 0) > 0 AS si,
      CASE WHEN closed THEN least(oe, coalesce(ce, oe)) ELSE oe END AS me, area, dup, closed, CASE WHEN m.contour_id % 6 = 0 THEN 1 ELSE 0 END AS br
      FROM m JOIN loops l ON m.contour_id = l.contour_id LEFT JOIN met ON met.contour_id = m.contour_id),
    full_report AS (SELECT *, list_filter([CASE WHEN closed AND NOT is_closed THEN 'open loop' END, CASE WHEN NOT closed THEN 'not marked closed' END,
      CASE WHEN NOT planar THEN 'non-planar' END, CASE WHEN me < 0.01 THEN 'minimum edge too short' END,
      CASE WHEN area <= 1e-12 THEN 'zero or tiny area' END, CASE WHEN si THEN 'self intersection' END], lambda e: e IS NOT NULL) AS errors,
      br + CASE WHEN dup > 0 THEN 1 ELSE 0 END AS wc FROM rep)"""


@register("validate_loops", f"""WITH {REPORT} SELECT design_id, contour_id, round(gap, 6) + 0.0 AS gap, is_closed, planar, si AS self_intersection,
    round(me, 6) AS min_edge, round(area, 5) AS area, dup AS duplicates, array_to_string(errors, '; ') AS errors, wc::BIGINT AS warning_count FROM full_report""")
def _(t):
    points, loops = loop_points(t)
    out = validate.validate_loops(points, loops, broken_loops(t), t.spans("circles"))
    return out.select(
        "design_id", "contour_id", *r("gap"), "is_closed", "planar", "self_intersection", *r("min_edge"), *r("area", digits=5),
        "duplicates", F.array_join("errors", "; ").alias("errors"), "warning_count",
    )


@register("robustness_score", f"""WITH {REPORT} SELECT design_id, sum(len(errors))::BIGINT AS error_count, sum(wc)::BIGINT AS warning_count,
    sum(len(errors)) = 0 AS valid, round(greatest(0.0, least(1.0, 1.0 - least(0.7, 0.15 * sum(len(errors))) - least(0.2, 0.03 * sum(wc))
      - sum(CASE WHEN gap > 1e-6 THEN least(0.2, gap / 0.01 * 0.1) ELSE 0.0 END + CASE WHEN me < 0.01 THEN 0.1 ELSE 0.0 END
        + CASE WHEN si THEN 0.4 ELSE 0.0 END + CASE WHEN NOT planar THEN 0.2 ELSE 0.0 END))), 6)::DOUBLE + 0.0 AS score FROM full_report GROUP BY design_id""")
def _(t):
    points, loops = loop_points(t)
    out = validate.robustness_score(validate.validate_loops(points, loops, broken_loops(t), t.spans("circles")))
    return out.withColumn("score", rounded(F.col("score")))


@register("constraint_score", f"""WITH {path()}, g AS (SELECT a.contour_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS gap FROM contours a
      JOIN contours b ON a.contour_id = b.contour_id AND b.idx > a.idx + 1 AND NOT (a.idx = 0 AND b.idx = 31) GROUP BY a.contour_id),
    m AS (SELECT contour_id, max(CASE WHEN {LA} <= 1e-12 OR {LB} <= 1e-12 THEN 180.0 ELSE degrees(acos(greatest(-1.0, least(1.0, {DOT} / ({LA} * {LB}))))) END) AS t
      FROM path WHERE {INNER} GROUP BY contour_id),
    s AS (SELECT m.contour_id, t, gap, contour_id_mod, (contour_id_mod % 3) + CASE WHEN t > 160 THEN 1 ELSE 0 END + CASE WHEN gap < 0.01 THEN 1 ELSE 0 END AS n
      FROM (SELECT *, contour_id % 10 AS contour_id_mod FROM m) m JOIN g ON m.contour_id = g.contour_id)
    SELECT contour_id, round(greatest(0.0, least(1.0, 0.5 + contour_id_mod / 10.0 - CASE WHEN t > 160 THEN least(0.25, (t - 160) / 180) ELSE 0.0 END
      - CASE WHEN gap < 0.01 THEN 0.2 ELSE 0.0 END - least(0.5, n * 0.12))), 5)::DOUBLE + 0.0 AS score FROM s""")
def _(t):
    points, spans = t.contours(), t.spans("contours")
    rows = contours.max_turn(points, spans).join(contours.minimum_gap(points, spans), "contour_id")
    mod = F.col("contour_id") % 10
    score = validate.constraint_score(F.lit(0.5) + mod / F.lit(10.0), F.col("max_turn"), F.col("minimum_gap"), mod % 3)
    return rows.select("contour_id", rounded(score, 5).alias("score"))


@register("complexity_metrics", f"""WITH parts AS (SELECT contour_id // 2 AS design_id, contour_id % 2 AS comp, idx // 4 AS prim, idx % 4 AS i,
      CASE (idx // 4) % 4 WHEN 0 THEN 'Line' WHEN 1 THEN 'arc' WHEN 2 THEN 'bspline' ELSE 'other' END AS type, contour_id * 8 + idx // 4 AS contour_id, x, y FROM contours),
    path AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM parts WINDOW w AS (PARTITION BY contour_id ORDER BY i)),
    p AS (SELECT design_id, comp, prim, any_value(lower(type)) NOT IN ('line', 'arc') AS sp, coalesce(sum(abs({HEADING})) FILTER ({INNER}), 0) AS b,
      count(*) FILTER ({LA} < 0.2) AS tiny FROM path GROUP BY design_id, comp, prim)
    SELECT design_id, count(DISTINCT comp) AS component_count, count(*) AS primitive_count, count(*) FILTER (sp) AS spline_count,
      round(sum(CASE WHEN sp THEN b ELSE 0.0 END), 5) AS curvature_sum, sum(tiny)::BIGINT AS tiny_count FROM p GROUP BY design_id""")
def _(t):
    c, i = F.col("contour_id"), F.col("idx")
    prim = F.expr("idx div 4")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Line", "arc", "bspline", "other")]), (prim % 4 + 1).cast("int"))
    rows = t.contours().select(
        F.expr("contour_id div 2").alias("design_id"), (c % 2).alias("comp"), prim.alias("primitive_id"), kind.alias("type"),
        (i % 4).alias("idx"), "x", "y",
    )
    out = validate.complexity_metrics(rows, spans=t.spans("contours"))
    return out.withColumn("curvature_sum", rounded(F.col("curvature_sum"), 5))


RECT = """patch AS (SELECT p_partkey AS design_id, p_size::DOUBLE AS width, (p_size % 13)::DOUBLE AS length, 1.0::DOUBLE AS cx, 2.0::DOUBLE AS cy,
      CASE WHEN p_partkey % 6 = 0 THEN 'copper' ELSE 'pec' END AS material FROM part),
    slots AS (SELECT l_partkey AS design_id, l_linenumber % 4 AS slot_id, CASE WHEN l_linenumber % 5 = 0 THEN 'hexagon' WHEN l_linenumber % 3 = 0 THEN 'circle' ELSE 'rectangle' END AS shape,
      1.0 + (l_linenumber - 3)::DOUBLE AS x, 2.0::DOUBLE AS y, l_quantity / 20 AS width, CASE WHEN l_linenumber = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS height FROM lineitem),
    feed AS (SELECT design_id, CASE WHEN design_id % 3 = 0 THEN cx - width / 2 ELSE cx END AS x, CASE WHEN design_id % 3 = 0 THEN cy WHEN design_id % 3 = 1 THEN cy - length / 2 ELSE cy + length / 4 END AS y,
      (design_id % 7)::DOUBLE / 2 AS width, CASE WHEN design_id % 5 = 0 THEN 'top' WHEN design_id % 3 = 0 THEN 'left' ELSE 'bottom' END AS direction FROM patch)"""


def rect_tables(t):
    c = F.col
    d = c("p_partkey")
    patch = t.table("part").select(
        d.alias("design_id"), c("p_size").cast("double").alias("width"), (c("p_size") % 13).cast("double").alias("length"),
        F.lit(1.0).alias("cx"), F.lit(2.0).alias("cy"), F.when(d % 6 == 0, "copper").otherwise("pec").alias("material"),
    )
    n = c("l_linenumber")
    slots = t.table("lineitem").select(
        c("l_partkey").alias("design_id"), (n % 4).alias("slot_id"),
        F.when(n % 5 == 0, "hexagon").when(n % 3 == 0, "circle").otherwise("rectangle").alias("shape"),
        (F.lit(1.0) + (n - 3).cast("double")).alias("x"), F.lit(2.0).alias("y"), (c("l_quantity") / 20).alias("width"),
        F.when(n == 2, 0.0).otherwise(0.5).alias("height"),
    )
    k = c("design_id")
    feed = patch.select(
        "design_id", F.when(k % 3 == 0, c("cx") - c("width") / 2).otherwise(c("cx")).alias("x"),
        F.when(k % 3 == 0, c("cy")).when(k % 3 == 1, c("cy") - c("length") / 2).otherwise(c("cy") + c("length") / 4).alias("y"),
        ((k % 7).cast("double") / 2).alias("width"),
        F.when(k % 5 == 0, "top").when(k % 3 == 0, "left").otherwise("bottom").alias("direction"),
    )
    return patch, slots, feed


@register("validate_rect_design", f"""WITH {RECT},
    b AS (SELECT *, cx - width / 2 AS l, cx + width / 2 AS r, cy - length / 2 AS bt, cy + length / 2 AS tp FROM patch),
    s AS (SELECT s.design_id, count(*) - count(DISTINCT slot_id) AS dup, count(*) FILTER (shape = 'hexagon') AS unk,
      count(*) FILTER (shape <> 'hexagon' AND NOT (s.width > 0 AND (shape <> 'rectangle' OR s.height > 0))) AS uns,
      count(*) FILTER (shape <> 'hexagon' AND NOT (x - s.width / 2 > l + 1e-7 AND x + s.width / 2 < r - 1e-7
        AND y - (CASE WHEN shape = 'circle' THEN s.width ELSE s.height END) / 2 > bt + 1e-7 AND y + (CASE WHEN shape = 'circle' THEN s.width ELSE s.height END) / 2 < tp - 1e-7)) AS outs
      FROM slots s JOIN b ON s.design_id = b.design_id GROUP BY s.design_id),
    e AS (SELECT b.*, f.x, f.y, f.width AS fw, f.direction, dup, unk, uns, outs,
      CASE WHEN abs(f.y - bt) <= 1e-7 AND f.x BETWEEN l - 1e-7 AND r + 1e-7 THEN 'bottom' WHEN abs(f.y - tp) <= 1e-7 AND f.x BETWEEN l - 1e-7 AND r + 1e-7 THEN 'top'
        WHEN abs(f.x - l) <= 1e-7 AND f.y BETWEEN bt - 1e-7 AND tp + 1e-7 THEN 'left' WHEN abs(f.x - r) <= 1e-7 AND f.y BETWEEN bt - 1e-7 AND tp + 1e-7 THEN 'right' END AS edge
      FROM b LEFT JOIN feed f ON b.design_id = f.design_id LEFT JOIN s ON b.design_id = s.design_id),
    x AS (SELECT design_id, array_to_string(list_filter([CASE WHEN NOT length > 0 THEN 'patch length' END, CASE WHEN NOT width > 0 THEN 'patch width' END,
      CASE WHEN upper(material) <> 'PEC' THEN 'patch material' END, CASE WHEN dup > 0 THEN 'duplicate slot id' END, CASE WHEN unk > 0 THEN 'slot shape' END,
      CASE WHEN uns > 0 THEN 'slot size' END, CASE WHEN outs > 0 THEN 'slot outside patch' END, CASE WHEN NOT fw > 0 THEN 'feed width' END,
      CASE WHEN fw > 0 AND edge IS NULL THEN 'feed off edge' END, CASE WHEN fw > 0 AND edge <> direction THEN 'feed direction' END,
      CASE WHEN fw > 0 AND edge IS NOT NULL AND CASE WHEN edge IN ('top', 'bottom') THEN x - fw / 2 < l - 1e-7 OR x + fw / 2 > r + 1e-7 ELSE y - fw / 2 < bt - 1e-7 OR y + fw / 2 > tp + 1e-7 END THEN 'feed span' END],
      lambda v: v IS NOT NULL), '; ') AS errors FROM e)
    SELECT design_id, errors, errors = '' AS valid FROM x""")
def _(t):
    out = validate.validate_rect_design(*rect_tables(t))
    return out.select("design_id", F.array_join("errors", "; ").alias("errors"), "valid")


BENT = """bent AS (SELECT contour_id, idx, x * 100 AS x, y * 100 AS y, x * 100 + CASE WHEN idx % 3 = 0 THEN (contour_id % 5) / 2.0 ELSE 0.0 END AS x2,
    y * 100 + (contour_id % 4) * 0.25 * (idx % 2) AS y2 FROM contours)"""


@register("shape_quality", f"""WITH {BENT},
    w AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2
      FROM bent WINDOW w AS (PARTITION BY contour_id ORDER BY idx)),
    k AS (SELECT contour_id, abs(atan2({CROSS}, {DOT})) / greatest(0.5 * ({LA} + {LB}), 1e-9) AS k1,
      abs(atan2(((x2 - px2) * (ny2 - y2) - (y2 - py2) * (nx2 - x2)), ((x2 - px2) * (nx2 - x2) + (y2 - py2) * (ny2 - y2))))
        / greatest(0.5 * (sqrt((x2 - px2) ** 2 + (y2 - py2) ** 2) + sqrt((nx2 - x2) ** 2 + (ny2 - y2) ** 2)), 1e-9) AS k2,
      (px2 - px) - 2 * (x2 - x) + (nx2 - nx) AS ddx, (py2 - py) - 2 * (y2 - y) + (ny2 - ny) AS ddy FROM w WHERE {INNER}),
    len AS (SELECT contour_id, sum({TO_NEXT}) AS l FROM w GROUP BY contour_id),
    s AS (SELECT k.contour_id, max(abs(k2 - k1)) AS d, sum(ddx * ddx + ddy * ddy) / (any_value(l) * any_value(l)) AS e FROM k JOIN len ON k.contour_id = len.contour_id GROUP BY k.contour_id)
    SELECT contour_id, round(d, 5) AS curvature_delta, round(e, 6) AS energy_ratio, d <= 0.3 AND e <= 0.18 AS valid,
      round(0.45 * greatest(0.0, 1 - d / 0.3) + 0.35 * greatest(0.0, 1 - e / 0.18) + 0.2, 5) AS score FROM s""")
def _(t):
    c, i = F.col("contour_id"), F.col("idx")
    before = t.contours().select("contour_id", "idx", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    after = before.select(
        "contour_id", "idx", (F.col("x") + F.when(i % 3 == 0, (c % 5) / F.lit(2.0)).otherwise(0.0)).alias("x"),
        (F.col("y") + (c % 4) * 0.25 * (i % 2)).alias("y"),
    )
    out = validate.shape_quality(before, after, spans=t.spans("contours"))
    return out.select("contour_id", *r("curvature_delta", digits=5), *r("energy_ratio"), "valid", *r("score", digits=5))


ENDS = """ends AS (SELECT design_id, idx AS primitive_id, CASE type WHEN 'spline' THEN 'BSPLINE' ELSE upper(type) END AS type, unnest(['start', 'end']) AS endpoint,
      unnest([x1, x2]) * 10 AS x, unnest([y1, y2]) * 10 AS y, unnest([x2 - x1, x1 - x2]) / len AS tx, unnest([y2 - y1, y1 - y2]) / len AS ty
    FROM (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM primitives))"""


def ends(t):
    c = F.col
    size = F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))
    point = lambda name, x, y, ox, oy: F.struct(
        F.lit(name).alias("endpoint"), (c(x) * 10).alias("x"), (c(y) * 10).alias("y"),
        ((c(ox) - c(x)) / size).alias("tx"), ((c(oy) - c(y)) / size).alias("ty"),
    )
    kind = F.when(c("type") == "spline", "BSPLINE").otherwise(F.upper("type"))
    return t.primitives().select(
        "design_id", c("idx").alias("primitive_id"), kind.alias("type"),
        F.inline(F.array(point("start", "x1", "y1", "x2", "y2"), point("end", "x2", "y2", "x1", "y1"))),
    )


@register("tangent_continuity", f"""WITH {ENDS} SELECT a.design_id, a.primitive_id, a.endpoint, b.primitive_id AS o_primitive_id, b.endpoint AS o_endpoint,
    round(degrees(acos(abs(greatest(-1.0, least(1.0, a.tx * b.tx + a.ty * b.ty))))), 4) AS angle FROM ends a JOIN ends b ON a.design_id = b.design_id AND a.primitive_id <> b.primitive_id
    AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.0
    WHERE a.type = 'BSPLINE' AND degrees(acos(abs(greatest(-1.0, least(1.0, a.tx * b.tx + a.ty * b.ty))))) > 70""")
def _(t):
    return validate.tangent_continuity(ends(t)).withColumn("angle", rounded(F.col("angle"), 4))
