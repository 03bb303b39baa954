"""Queries over outlines."""

from pyspark.sql import functions as F

from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import contours


def path(view="contours"):
    return f"""path AS (SELECT contour_id, idx, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny
    FROM {view} WINDOW w AS (PARTITION BY contour_id ORDER BY idx))"""


def ring(view="contours"):
    return f"""ring AS (SELECT contour_id, idx, x, y, coalesce(lag(x) OVER w, last_value(x) OVER a) AS px, coalesce(lag(y) OVER w, last_value(y) OVER a) AS py,
    coalesce(lead(x) OVER w, first_value(x) OVER a) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER a) AS ny,
    lead(x) OVER w IS NULL AS is_last, lag(x) OVER w IS NULL AS is_first, count(*) OVER a AS n FROM {view}
    WINDOW w AS (PARTITION BY contour_id ORDER BY idx),
      a AS (PARTITION BY contour_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


TO_NEXT = "sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))"


def r(*names, digits=6):
    return [rounded(F.col(n), digits).alias(n) for n in names]


@register("bbox", """SELECT contour_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
    FROM contours GROUP BY contour_id""")
def _(t):
    return contours.bbox(t.contours())


@register("normalized_box", """SELECT contour_id, idx, least(x1, x2) AS min_x, least(y1, y2) AS min_y, greatest(x1, x2) AS max_x,
    greatest(y1, y2) AS max_y FROM edges""")
def _(t):
    e = t.primitives().withColumnRenamed("design_id", "contour_id")
    return e.select("contour_id", "idx", *contours.normalized_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))


@register("signed_area", f"WITH {ring('circles')} SELECT contour_id, round(sum(x * ny - nx * y) / 2, 6) + 0.0 AS signed_area FROM ring GROUP BY contour_id")
def _(t):
    return contours.signed_area(t.circles(), t.spans("circles")).select("contour_id", *r("signed_area"))


@register("polyline_length", f"WITH {path()} SELECT contour_id, round(sum({TO_NEXT}), 6) AS length FROM path GROUP BY contour_id")
def _(t):
    return contours.polyline_length(t.contours(), spans=t.spans("contours")).select("contour_id", *r("length"))


@register("edge_stats", f"""WITH {ring()}, sized AS (SELECT *, {TO_NEXT} AS d FROM ring)
    SELECT contour_id, count(*) FILTER ((NOT is_last OR d > 1e-9) AND d < 0.1) AS tiny_count,
      round(min(d) FILTER (NOT is_last OR d > 1e-12), 6) AS min_edge FROM sized GROUP BY contour_id""")
def _(t):
    return contours.edge_stats(t.contours(), 0.1, True, t.spans("contours")).select("contour_id", "tiny_count", *r("min_edge"))


@register("min_feature_and_gaps", f"""WITH {ring()}, sized AS (SELECT *, {TO_NEXT} AS d FROM ring)
    SELECT contour_id, round(min(d) FILTER (d > 1e-10), 6) AS min_feature, round(max(d) FILTER (NOT is_last), 6) AS max_gap,
      round(avg(d) FILTER (NOT is_last), 6) AS mean_gap, max(d) FILTER (NOT is_last) < 10 AS connected FROM sized GROUP BY contour_id""")
def _(t):
    out = contours.min_feature_and_gaps(t.contours(), t.spans("contours"))
    return out.select("contour_id", *r("min_feature", "max_gap", "mean_gap"), "connected")


@register("duplicate_points", f"""WITH {path()} SELECT contour_id,
    count(*) FILTER (sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 0.08) AS duplicates FROM path GROUP BY contour_id""")
def _(t):
    return contours.duplicate_points(t.contours(), 0.08, t.spans("contours"))


@register("drop_duplicates_lag", f"""WITH {path()} SELECT contour_id, idx FROM path
    WHERE px IS NULL OR sqrt((x - px) * (x - px) + (y - py) * (y - py)) >= 0.08""")
def _(t):
    return contours.drop_duplicates_lag(t.contours(), 0.08, t.spans("contours")).select("contour_id", "idx")


@register("grid_duplicates", """WITH keyed AS (SELECT contour_id, idx, round_even(x * 20, 0) AS gx, round_even(y * 20, 0) AS gy FROM contours),
    firsts AS (SELECT *, min(idx) OVER (PARTITION BY contour_id, gx, gy) AS first_index FROM keyed)
    SELECT contour_id, first_index, idx AS duplicate_index FROM firsts WHERE idx > first_index""")
def _(t):
    return contours.grid_duplicates(t.contours(), 0.05, t.spans("contours"))


def crossing_sql(variant):
    if variant == "gate":
        keep, tol, limit = "NOT is_last", "0.0", "0.0"
    else:
        keep = {"touch": f"NOT is_last OR {TO_NEXT} > 1e-9", "proper": "NOT is_last OR x <> nx OR y <> ny", "loop": "true"}[variant]
        tol = {"touch": "1e-9", "proper": "0.0", "loop": "1e-7"}[variant]
        limit = "-1e-7" if variant == "loop" else "0.0"
    skip = "j.idx > i.idx" if variant == "gate" else "j.idx > i.idx + 1 AND NOT (i.idx = 0 AND j.idx = i.last)"
    turn = lambda p, q, s: f"(({q}x - {p}x) * ({s}y - {p}y) - ({q}y - {p}y) * ({s}x - {p}x))"
    on = lambda p, q, s: (
        f"({q}x BETWEEN least({p}x, {s}x) - {tol} AND greatest({p}x, {s}x) + {tol} AND "
        f"{q}y BETWEEN least({p}y, {s}y) - {tol} AND greatest({p}y, {s}y) + {tol})"
    )
    o1, o2, o3, o4 = turn("a", "b", "c"), turn("a", "b", "d"), turn("c", "d", "a"), turn("c", "d", "b")
    meets = f"({o1} * {o2} < {limit} AND {o3} * {o4} < {limit})"
    if variant != "proper":
        for o, (p, q, s) in ((o1, "acb"), (o2, "adb"), (o3, "cad"), (o4, "cbd")):
            meets += f" OR (abs({o}) <= {tol} AND {on(p, q, s)})"
    if variant == "gate":
        meets = f"""NOT (greatest(ax, bx) < least(cx, dx) OR greatest(cx, dx) < least(ax, bx)
            OR greatest(ay, by_) < least(cy, dy) OR greatest(cy, dy) < least(ay, by_)) AND ({meets})"""
    meets = meets.replace("by", "by_").replace("by__", "by_")
    return f"""{ring()}, es AS (SELECT contour_id, idx, x AS ax, y AS ay, nx AS bx, ny AS by_, max(idx) OVER (PARTITION BY contour_id) AS last
        FROM ring WHERE {keep}),
    pairs AS (SELECT i.contour_id, i.ax, i.ay, i.bx, i.by_, j.ax AS cx, j.ay AS cy, j.bx AS dx, j.by_ AS dy
        FROM es i JOIN es j ON i.contour_id = j.contour_id AND {skip}),
    met AS (SELECT contour_id, count(*) AS c FROM pairs WHERE {meets} GROUP BY contour_id),
    ids AS (SELECT contour_id, count(*) AS n FROM contours GROUP BY contour_id)"""


for variant in ("touch", "proper", "loop"):
    register(f"self_intersections_{variant}", f"""WITH {crossing_sql(variant)}
        SELECT i.contour_id, coalesce(c, 0) AS crossings FROM ids i LEFT JOIN met m ON i.contour_id = m.contour_id""")(
        lambda t, v=variant: contours.self_intersections(t.contours(), v, t.spans("contours"))
    )


@register("crossing_count_equals_edges", f"""WITH {crossing_sql('gate')}
    SELECT i.contour_id, coalesce(c, 0) AS pairs, n - 1 AS segments, coalesce(c, 0) = n - 1 AS passes
    FROM ids i LEFT JOIN met m ON i.contour_id = m.contour_id""")
def _(t):
    return contours.crossing_count_equals_edges(t.contours(), t.spans("contours"))


@register("minimum_gap", """SELECT a.contour_id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS minimum_gap
    FROM contours a JOIN contours b ON a.contour_id = b.contour_id AND b.idx > a.idx + 1 AND NOT (a.idx = 0 AND b.idx = 31) GROUP BY a.contour_id""")
def _(t):
    return contours.minimum_gap(t.contours(), t.spans("contours")).select("contour_id", *r("minimum_gap"))


LA, LB = "sqrt((x - px) * (x - px) + (y - py) * (y - py))", "sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))"
DOT = "((x - px) * (nx - x) + (y - py) * (ny - y))"
CROSS = "((x - px) * (ny - y) - (y - py) * (nx - x))"
TURN = f"CASE WHEN {LA} <= 1e-12 OR {LB} <= 1e-12 THEN 180.0 ELSE degrees(acos(greatest(-1.0, least(1.0, {DOT} / ({LA} * {LB}))))) END"
HEADING = """((atan2(ny - y, nx - x) - atan2(y - py, x - px) + pi()) - 2 * pi() * floor((atan2(ny - y, nx - x) - atan2(y - py, x - px) + pi()) / (2 * pi())) - pi())"""
INNER = "px IS NOT NULL AND nx IS NOT NULL"


@register("turning_angles", f"WITH {path()} SELECT contour_id, idx, round({TURN}, 5) AS turn FROM path WHERE {INNER}")
def _(t):
    return contours.turning_angles(t.contours(), t.spans("contours")).select("contour_id", "idx", *r("turn", digits=5))


@register("max_turn", f"WITH {path()} SELECT contour_id, round(max({TURN}) FILTER ({INNER}), 4) AS max_turn FROM path GROUP BY contour_id")
def _(t):
    return contours.max_turn(t.contours(), t.spans("contours")).select("contour_id", *r("max_turn", digits=4))


@register("curvature_profile", f"""WITH {path()} SELECT contour_id, idx, round(CASE WHEN {LA} <= 1e-12 OR {LB} <= 1e-12 THEN 0.0
    ELSE abs(atan2({CROSS}, {DOT})) / greatest(0.5 * ({LA} + {LB}), 1e-9) END, 5) AS curvature FROM path WHERE {INNER}""")
def _(t):
    return contours.curvature_profile(t.contours(), t.spans("contours")).select("contour_id", "idx", *r("curvature", digits=5))


@register("curvature_proxy", f"WITH {path()} SELECT contour_id, round(sum(abs({HEADING})), 6) AS curvature_proxy FROM path WHERE {INNER} GROUP BY contour_id")
def _(t):
    return contours.curvature_proxy(t.contours(), t.spans("contours")).select("contour_id", *r("curvature_proxy"))


@register("heading_variance_score", f"""WITH {path()}, v AS (SELECT contour_id, var_pop({HEADING}) AS heading_variance FROM path WHERE {INNER} GROUP BY contour_id)
    SELECT contour_id, round(heading_variance, 6) AS heading_variance, round(1.0 / (1.0 + heading_variance / (0.5 + 1e-9)), 6) AS stability_score FROM v""")
def _(t):
    out = contours.heading_variance_score(t.contours(), spans=t.spans("contours"))
    return out.select("contour_id", *r("heading_variance", "stability_score"))


@register("curvature_continuity", f"""WITH {ring()}, b AS (SELECT contour_id, (idx + 31) % 32 AS i, abs({CROSS}) / ({LA} * {LA} * {LA} + 1e-10) AS k
      FROM ring WHERE {LA} > 1e-10 AND {LB} > 1e-10),
    s AS (SELECT contour_id, abs(k - lag(k) OVER (PARTITION BY contour_id ORDER BY i)) AS d FROM b)
    SELECT contour_id, round(1.0 / (1.0 + avg(d)), 6) AS continuity FROM s GROUP BY contour_id""")
def _(t):
    return contours.curvature_continuity(t.contours(), t.spans("contours")).select("contour_id", *r("continuity"))


@register("right_angle_ratio", f"""WITH {ring()}, a AS (SELECT contour_id, degrees(acos(greatest(-1.0, least(1.0, {DOT} / ({LA} * {LB}))))) AS g FROM ring
      WHERE {LA} > 1e-10 AND {LB} > 1e-10)
    SELECT contour_id, round(count(*) FILTER (abs(g - 90) < 5)::DOUBLE / count(*), 6) AS right_angle_ratio FROM a GROUP BY contour_id""")
def _(t):
    return contours.right_angle_ratio(t.contours(), t.spans("contours")).select("contour_id", *r("right_angle_ratio"))


@register("planarity", """WITH lifted AS (SELECT contour_id, idx, CASE WHEN contour_id % 3 = 0 THEN 1.5 ELSE x * y END AS z FROM contours),
    f AS (SELECT contour_id, arg_min(z, idx) AS z0 FROM lifted GROUP BY contour_id)
    SELECT l.contour_id, round(max(abs(z - z0)), 6) AS max_deviation, max(abs(z - z0)) < 1e-6 AS planar
    FROM lifted l JOIN f ON l.contour_id = f.contour_id GROUP BY l.contour_id""")
def _(t):
    z = F.when(F.col("contour_id") % 3 == 0, F.lit(1.5)).otherwise(F.col("x") * F.col("y"))
    return contours.planarity(t.contours().withColumn("z", z)).select("contour_id", *r("max_deviation"), "planar")


@register("closure_gap", """WITH e AS (SELECT contour_id, arg_min(x, idx) AS ax, arg_min(y, idx) AS ay, arg_max(x, idx) AS bx, arg_max(y, idx) AS b_y FROM contours GROUP BY contour_id)
    SELECT contour_id, round(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 6) AS gap,
      sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) < 0.1 AS closed FROM e""")
def _(t):
    return contours.closure_gap(t.contours(), 0.1).select("contour_id", *r("gap"), "closed")


@register("segment_connectivity", """WITH s AS (SELECT contour_id, idx, x1, y1, x2 + CASE WHEN (contour_id + idx) % 5 = 0 THEN 0.25 ELSE 0.0 END AS x2, y2 FROM edges),
    g AS (SELECT contour_id, idx, sqrt((lead(x1) OVER w - x2) * (lead(x1) OVER w - x2) + (lead(y1) OVER w - y2) * (lead(y1) OVER w - y2)) AS gap
      FROM s WINDOW w AS (PARTITION BY contour_id ORDER BY idx))
    SELECT contour_id, idx AS segment_index, round(gap, 6) AS gap FROM g WHERE gap > 1e-6""")
def _(t):
    off = F.when((F.col("contour_id") + F.col("idx")) % 5 == 0, F.lit(0.25)).otherwise(F.lit(0.0))
    e = t.primitives().withColumnRenamed("design_id", "contour_id").withColumn("x2", F.col("x2") + off).drop("type")
    return contours.segment_connectivity(e, spans=t.spans("contours")).select("contour_id", "segment_index", *r("gap"))


CANVAS = """canvas AS (SELECT vec_id AS contour_id, (vec_id % 4)::DOUBLE / 10 AS width, 0.2::DOUBLE AS height FROM embeddings WHERE vec_id % 5 <> 0)"""


def canvas(t):
    v = F.col("vec_id")
    return t.table("embeddings").filter(v % 5 != 0).select(
        v.alias("contour_id"), ((v % 4).cast("double") / 10).alias("width"), F.lit(0.2).alias("height")
    )


@register("outside_ratio", f"""WITH {CANVAS} SELECT c.contour_id, round(avg(CASE WHEN width > 0 AND height > 0 AND
      (x < -0.05 * width OR x > width + 0.05 * width OR y < -0.05 * height OR y > height + 0.05 * height) THEN 1.0 ELSE 0.0 END), 6) AS outside_ratio
    FROM contours c LEFT JOIN canvas k ON c.contour_id = k.contour_id GROUP BY c.contour_id""")
def _(t):
    return contours.outside_ratio(t.contours(), canvas(t)).select("contour_id", *r("outside_ratio"))


COMPONENTS = """comps AS (SELECT vec_id // 4 AS design_id, vec_id % 4 AS comp, vec_id % 3 <> 0 AS closed, 32 AS nodes, 31 + vec_id % 2 AS edges FROM embeddings),
    refs AS (SELECT design_id, comp, CASE WHEN design_id % 5 = 0 THEN true ELSE closed END AS closed,
      nodes + CASE WHEN design_id % 7 = 0 THEN 1 ELSE 0 END AS nodes, edges + CASE WHEN design_id % 6 = 0 THEN comp ELSE 0 END AS edges
      FROM comps WHERE NOT (design_id % 9 = 0 AND comp = 3))"""


def components(t):
    v = F.col("vec_id")
    comps = t.table("embeddings").select(
        F.expr("vec_id div 4").alias("design_id"), (v % 4).alias("comp"), (v % 3 != 0).alias("closed"),
        F.lit(32).cast("long").alias("nodes"), (F.lit(31) + v % 2).alias("edges"),
    )
    d = F.col("design_id")
    refs = comps.filter(~((d % 9 == 0) & (F.col("comp") == 3))).select(
        "design_id", "comp", F.when(d % 5 == 0, F.lit(True)).otherwise(F.col("closed")).alias("closed"),
        (F.col("nodes") + F.when(d % 7 == 0, 1).otherwise(0)).alias("nodes"),
        (F.col("edges") + F.when(d % 6 == 0, F.col("comp")).otherwise(0)).alias("edges"),
    )
    return comps, refs


@register("topology_signature", f"""WITH {COMPONENTS} SELECT design_id, count(*) AS component_count, count(*) FILTER (closed) AS closed_count,
    sum(nodes)::BIGINT AS node_count, sum(edges)::BIGINT AS edge_count FROM comps GROUP BY design_id""")
def _(t):
    return contours.topology_signature(components(t)[0])


@register("topology_diff", f"""WITH {COMPONENTS},
    a AS (SELECT design_id, count(*) AS n, list(closed ORDER BY comp) AS f, sum(nodes) AS p, sum(edges) AS e FROM comps GROUP BY design_id),
    b AS (SELECT design_id, count(*) AS n, list(closed ORDER BY comp) AS f, sum(nodes) AS p, sum(edges) AS e FROM refs GROUP BY design_id)
    SELECT a.design_id, a.n <> b.n AS component_count_changed, a.f <> b.f AS closed_flags_changed, a.p <> b.p AS node_count_changed,
      a.e <> b.e AS edge_count_changed FROM a JOIN b ON a.design_id = b.design_id""")
def _(t):
    return contours.topology_diff(*components(t))


@register("resample_every", """WITH kept AS (SELECT contour_id, idx // 5 AS idx, CASE WHEN idx = 30 THEN first_value(x) OVER w ELSE x END AS x,
      CASE WHEN idx = 30 THEN first_value(y) OVER w ELSE y END AS y FROM contours WHERE idx % 5 = 0 WINDOW w AS (PARTITION BY contour_id ORDER BY idx))
    SELECT * FROM kept UNION ALL SELECT contour_id + 1000000, idx // 4, x, y FROM contours WHERE idx % 4 = 0
    UNION ALL SELECT contour_id + 1000000, 8, x, y FROM contours WHERE idx = 0""")
def _(t):
    points = t.contours()
    other = points.withColumn("contour_id", F.col("contour_id") + 1000000)
    return contours.resample_every(points, 5).unionByName(contours.resample_every(other, 4))


@register("densify", """WITH k AS (SELECT unnest(range(0, 128)) AS k),
    p AS (SELECT contour_id, idx, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY idx))
    SELECT contour_id, idx * 4 + k AS idx, round(CASE WHEN k = 0 THEN x ELSE x + (nx - x) * (k / 4) END, 6) AS x,
      round(CASE WHEN k = 0 THEN y ELSE y + (ny - y) * (k / 4) END, 6) AS y FROM p, k
    WHERE k < 4 AND (k = 0 OR nx IS NOT NULL) AND idx * 4 + k < 100""")
def _(t):
    return contours.densify(t.contours(), 100, t.spans("contours")).select("contour_id", "idx", *r("x", "y"))


@register("filter_contours", f"""WITH {ring('circles')}, m AS (SELECT contour_id, count(*) AS point_count, abs(sum(x * ny - nx * y) / 2) AS area, sum({TO_NEXT}) AS perimeter FROM ring GROUP BY contour_id)
    SELECT contour_id, point_count, round(area, 6) AS area, round(perimeter, 6) AS perimeter FROM m WHERE point_count >= 3 AND area >= 10 AND perimeter >= 10""")
def _(t):
    return contours.filter_contours(t.circles(), spans=t.spans("circles")).select("contour_id", "point_count", *r("area", "perimeter"))


SKEWED = """shapes AS (SELECT contour_id, idx, x + CASE WHEN contour_id % 4 = 1 AND idx = 2 OR contour_id % 4 = 3 AND idx IN (2, 10) THEN 0.5 ELSE 0.0 END AS x,
    y + CASE WHEN contour_id % 4 = 2 AND idx IN (1, 5) THEN 0.5 ELSE 0.0 END AS y FROM circles)"""


def shapes(t):
    k, i = F.col("contour_id") % 4, F.col("idx")
    dx = F.when(((k == 1) & (i == 2)) | ((k == 3) & i.isin(2, 10)), 0.5).otherwise(0.0)
    dy = F.when((k == 2) & i.isin(1, 5), 0.5).otherwise(0.0)
    return t.circles().select("contour_id", "idx", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


@register("mirror_symmetry", f"""WITH {SKEWED}, b AS (SELECT contour_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM shapes GROUP BY contour_id),
    k AS (SELECT DISTINCT contour_id, round(x, 6) + 0.0 AS kx, round(y, 6) + 0.0 AS ky FROM shapes),
    m AS (SELECT s.contour_id,
      bool_and(EXISTS (SELECT 1 FROM k WHERE k.contour_id = s.contour_id AND k.kx = round(s.x, 6) + 0.0 AND k.ky = round(2 * b.cy - s.y, 6) + 0.0)) AS ax,
      bool_and(EXISTS (SELECT 1 FROM k WHERE k.contour_id = s.contour_id AND k.kx = round(2 * b.cx - s.x, 6) + 0.0 AND k.ky = round(s.y, 6) + 0.0)) AS ay
      FROM shapes s JOIN b ON s.contour_id = b.contour_id GROUP BY s.contour_id)
    SELECT contour_id, CASE WHEN ax AND ay THEN 'xy' WHEN ax THEN 'x' WHEN ay THEN 'y' ELSE 'none' END AS symmetry FROM m""")
def _(t):
    return contours.mirror_symmetry(shapes(t))


RECTS = """rects AS (SELECT p_partkey AS contour_id, i AS idx, CASE WHEN i IN (1, 2) THEN p_size ELSE 0 END::DOUBLE
      + CASE WHEN p_partkey % 3 = 1 AND i = 2 THEN 0.5 ELSE 0 END AS x, CASE WHEN i IN (2, 3) THEN 4 WHEN i = 4 THEN 2 ELSE 0 END::DOUBLE AS y
    FROM part, (SELECT unnest(range(0, 5)) AS i) WHERE i < 4 OR p_partkey % 5 = 0)"""


@register("is_rectangle", f"""WITH {RECTS}, b AS (SELECT contour_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, count(*) AS n FROM rects GROUP BY contour_id),
    s AS (SELECT b.contour_id, any_value(n) AS n, count(DISTINCT (x, y)) FILTER ((x = a OR x = b) AND (y = c OR y = d)) AS corners,
      bool_and((x = a OR x = b) AND (y = c OR y = d)) AS all_in FROM rects r JOIN b ON r.contour_id = b.contour_id GROUP BY b.contour_id)
    SELECT contour_id, n = 4 AND corners = 4 AND all_in AS rectangle, corners = 4 AS has_corners FROM s""")
def _(t):
    i, key = F.col("idx"), F.col("p_partkey")
    rows = t.table("part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx"))
    points = rows.filter((i < 4) | (key % 5 == 0)).select(
        key.alias("contour_id"), i.cast("long").alias("idx"),
        (F.when(i.isin(1, 2), F.col("p_size")).otherwise(0).cast("double") + F.when((key % 3 == 1) & (i == 2), 0.5).otherwise(0.0)).alias("x"),
        F.when(i.isin(2, 3), 4).when(i == 4, 2).otherwise(0).cast("double").alias("y"),
    )
    return contours.is_rectangle(points, t.spans("circles"))


@register("contour_depth_tree", """WITH RECURSIVE walk AS (SELECT id, parent AS up FROM hierarchy WHERE id % 2 = 1
      UNION ALL SELECT w.id, h.parent FROM walk w JOIN hierarchy h ON h.id = w.up WHERE w.up >= 0 AND w.up % 2 = 0)
    SELECT id, max(CASE WHEN up >= 0 AND up % 2 = 1 THEN up END) AS ancestor FROM walk GROUP BY id""")
def _(t):
    return contours.contour_depth_tree(t.hierarchy())


@register("pixel_scale", f"""WITH {ring('circles')} SELECT contour_id, round(2 * (6.6 + 6.6) / floor(sum({TO_NEXT}) * 10 + 0.3), 6) AS scale FROM ring GROUP BY contour_id""")
def _(t):
    closed = contours.polyline_length(t.circles(), True, t.spans("circles"))
    return closed.select("contour_id", rounded(contours.pixel_scale(F.col("length") * 10 + 0.3, F.lit(6.6), F.lit(6.6))).alias("scale"))


@register("curve_geometry_score", f"""WITH {ring()}, {path()},
    v AS (SELECT contour_id, var_pop({HEADING}) AS v FROM path WHERE {INNER} GROUP BY contour_id),
    m AS (SELECT contour_id, sum({TO_NEXT}) AS len, abs(sum(x * ny - nx * y) / 2) AS area FROM ring GROUP BY contour_id),
    f AS (SELECT m.contour_id, (m.contour_id % 10)::DOUBLE / 10 AS q, m.contour_id % 3 = 0 AS fits, m.contour_id % 2 = 0 AS closed, m.contour_id % 4 <> 0 AS outr,
      1.0 / (1.0 + v / (0.5 + 1e-9)) AS st, len, area FROM m JOIN v ON m.contour_id = v.contour_id)
    SELECT contour_id, round(least(1.0, CASE WHEN fits THEN 0.4 * q ELSE 0.1 * (1.0 - q) END + 0.15 * st + 0.2 * least(1.0, len / 4.0 * 10)
      + 0.25 * least(1.0, CASE WHEN closed THEN 0.4 ELSE 0.1 END + CASE WHEN outr THEN 0.3 ELSE 0.1 END
      + CASE WHEN area > 0 THEN 0.3 * least(1.0, ln(1 + area * 100) / ln(11)) ELSE 0.05 END)), 6) AS score FROM f""")
def _(t):
    points, spans = t.contours(), t.spans("contours")
    k = F.col("contour_id")
    features = (
        contours.heading_variance_score(points, spans=spans)
        .join(contours.polyline_length(points, True, spans), "contour_id")
        .join(contours.signed_area(points, spans), "contour_id")
        .select(
            "contour_id", "stability_score", "length", F.abs("signed_area").alias("area"), ((k % 10).cast("double") / 10).alias("fit_quality"),
            (k % 3 == 0).alias("fits"), (k % 2 == 0).alias("closed"), (k % 4 != 0).alias("outer"),
            F.lit(4.0).alias("image_perimeter"), F.lit(1.0).alias("image_area"),
        )
    )
    return contours.curve_geometry_score(features).select("contour_id", *r("score"))


@register("orient_ccw", f"""WITH {ring()}, a AS (SELECT contour_id, sum(x * ny - nx * y) / 2 AS area FROM ring GROUP BY contour_id)
    SELECT c.contour_id, CASE WHEN area < 0 THEN 31 - idx ELSE idx END AS idx, x, y FROM contours c JOIN a ON c.contour_id = a.contour_id""")
def _(t):
    return contours.orient_ccw(t.contours(), t.spans("contours"))
