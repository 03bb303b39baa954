"""Queries over primitives, ports and design variables."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import r
from sweepfield.catalog.registry import register
from sweepfield.catalog.validation import rect_tables, RECT
from sweepfield.functions.numeric import rounded
from sweepfield.operators import primitives, validate

# Contour edges in hundredths, with their type in capitals and the design's extent.
PRIMS = """prims AS (SELECT design_id, idx AS seq, 'c' || design_id || '_s' || idx AS primitive_id, CASE type WHEN 'spline' THEN 'BSPLINE' ELSE upper(type) END AS type,
      x1 * 100 AS x1, y1 * 100 AS y1, x2 * 100 AS x2, y2 * 100 AS y2, (x1 * 100 + x2 * 100) / 2 AS cx, (y1 * 100 + y2 * 100) / 2 AS cy FROM primitives),
    extents AS (SELECT design_id, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y, max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y,
      CASE design_id % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'bottom' END AS side FROM prims GROUP BY design_id)"""
ZONES = PRIMS + """,
    borders AS (SELECT *, 0.08 * greatest(1e-9, max_x - min_x) AS mx, 0.08 * greatest(1e-9, max_y - min_y) AS my,
      CASE WHEN side IS NULL THEN CASE WHEN max_x - min_x >= max_y - min_y THEN 'lx' ELSE 'ly' END WHEN side = 'left' THEN 'lx' WHEN side = 'right' THEN 'hx' WHEN side = 'top' THEN 'ly' ELSE 'hy' END AS b FROM extents),
    zones AS (SELECT design_id, min_x, min_y, max_x, max_y, coalesce(side, CASE WHEN max_x - min_x >= max_y - min_y THEN 'left' ELSE 'bottom' END) AS side,
      CASE b WHEN 'lx' THEN [min_x - 1e-6, min_y, min_x + mx, max_y] WHEN 'hx' THEN [max_x - mx, min_y, max_x + 1e-6, max_y]
        WHEN 'ly' THEN [min_x, min_y - 1e-6, max_x, min_y + my] ELSE [min_x, max_y - my, max_x, max_y + 1e-6] END AS core,
      CASE b WHEN 'lx' THEN [min_x + mx, min_y, min_x + 3 * mx, max_y] WHEN 'hx' THEN [max_x - 3 * mx, min_y, max_x - mx, max_y]
        WHEN 'ly' THEN [min_x, min_y + my, max_x, min_y + 3 * my] ELSE [min_x, max_y - 3 * my, max_x, max_y - my] END AS near FROM borders)"""
ROLES = ZONES + """,
    roles AS (SELECT p.*, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length, CASE WHEN cx BETWEEN core[1] AND core[3] AND cy BETWEEN core[2] AND core[4] THEN 'PORT'
      WHEN cx BETWEEN near[1] AND near[3] AND cy BETWEEN near[2] AND near[4] THEN 'FEEDLINE' WHEN type = 'BSPLINE' THEN 'RESONANT_SLOT'
      WHEN type = 'LINE' AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) > 0.2 * sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2)
        AND (abs(x2 - x1) < 0.15 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) OR abs(y2 - y1) < 0.15 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) THEN 'FEEDLINE'
      ELSE 'STRUCTURAL' END AS role FROM prims p JOIN zones z ON p.design_id = z.design_id)"""


def prims(t):
    c = F.col
    kind = F.when(c("type") == "spline", "BSPLINE").otherwise(F.upper("type"))
    rows = t.primitives().select(
        "design_id", c("idx").alias("seq"), F.concat(F.lit("c"), c("design_id"), F.lit("_s"), c("idx")).alias("primitive_id"), kind.alias("type"),
        *[(c(n) * 100).alias(n) for n in ("x1", "y1", "x2", "y2")],
    )
    return rows.select("*", ((c("x1") + c("x2")) / 2).alias("cx"), ((c("y1") + c("y2")) / 2).alias("cy"))


def boxes(t):
    k = F.col("design_id") % 5
    side = F.when(k == 0, "left").when(k == 1, "right").when(k == 2, "top").when(k == 3, "bottom")
    return prims(t).groupBy("design_id").agg(
        F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"),
    ).withColumn("side", side)


def roles(t):
    c = F.col
    return primitives.primitive_role(prims(t), primitives.port_zones(boxes(t))).withColumn(
        "length", F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))
    )


@register("primitive_summary", f"""WITH {ROLES} SELECT design_id, count(*) AS primitive_count, count(*) FILTER (type = 'LINE') AS line_count,
    count(*) FILTER (type = 'HOLE') AS hole_count, count(*) FILTER (role = 'SLOT') AS slot_count, count(*) FILTER (type = 'BSPLINE') AS bspline_count,
    count(*) FILTER (type IN ('ARC', 'CURVE')) AS curve_count, count(*) FILTER (seq % 3 = 0) AS linearized_curve_count,
    count(*) FILTER (role = 'PORT') AS port_count, count(*) FILTER (role = 'FEEDLINE') AS feedline_count FROM roles GROUP BY design_id""")
def _(t):
    rows = roles(t).withColumn("original_type", F.when(F.col("seq") % 3 == 0, "ARC"))
    return primitives.primitive_summary(rows)


@register("primitive_type", """SELECT p_partkey, CASE WHEN contains(k, 'spline') THEN 'BSPLINE' WHEN contains(k, 'line') THEN 'LINE' WHEN contains(k, 'arc') THEN 'ARC'
    WHEN contains(k, 'curve') THEN 'CURVE' WHEN contains(k, 'port') THEN 'PORT' WHEN contains(k, 'feed') THEN 'FEEDLINE' ELSE 'UNKNOWN' END AS type
    FROM (SELECT p_partkey, lower(p_name || ['B-Spline', 'PolyLine', 'arc3', 'Curve', 'port1', 'FEED', '', 'x'][1 + p_partkey % 8]) AS k FROM part)""")
def _(t):
    words = F.array(*[F.lit(w) for w in ("B-Spline", "PolyLine", "arc3", "Curve", "port1", "FEED", "", "x")])
    raw = F.concat("p_name", F.element_at(words, (F.col("p_partkey") % 8 + 1).cast("int")))
    return t.table("part").select("p_partkey", primitives.primitive_type(raw).alias("type"))


@register("port_zones", f"""WITH {ZONES} SELECT design_id, side, {', '.join(f'round(core[{i}], 6) AS core_{i}, round(near[{i}], 6) AS near_{i}' for i in range(1, 5))} FROM zones""")
def _(t):
    out = primitives.port_zones(boxes(t))
    cell = lambda n, i: rounded(F.get(n, F.lit(i - 1))).alias(f"{n}_{i}")
    return out.select("design_id", "side", *[cell(n, i) for i in range(1, 5) for n in ("core", "near")])


@register("primitive_role", f"WITH {ROLES} SELECT design_id, seq, role FROM roles")
def _(t):
    return roles(t).select("design_id", "seq", "role")


@register("optimization_mode", f"""WITH {ROLES} SELECT design_id, seq, CASE WHEN role = 'PORT' THEN 'FROZEN' WHEN role = 'FEEDLINE' THEN 'FEED_DIRECTION_ONLY'
    WHEN type = 'LINE' THEN 'RIGID_LINE_OFFSET' WHEN type = 'BSPLINE' THEN 'SMOOTH_DEFORM' WHEN type IN ('ARC', 'CURVE') THEN 'CURVE_SMOOTH_OFFSET' ELSE 'DEPENDENT_CACHE_ONLY' END AS mode FROM roles""")
def _(t):
    return roles(t).select("design_id", "seq", primitives.optimization_mode(F.col("type"), F.col("role")).alias("mode"))


@register("point_roles", """SELECT contour_id, idx, CASE WHEN idx IN (0, 31) THEN 'ENDPOINT' WHEN contour_id % 2 = 0 AND idx IN (1, 30) THEN 'HANDLE_POINT' ELSE 'INTERNAL_POINT' END AS point_role FROM contours""")
def _(t):
    points = t.contours().withColumn("type", F.when(F.col("contour_id") % 2 == 0, "BSPLINE").otherwise("LINE"))
    return primitives.point_roles(points, ["contour_id"], t.spans("contours")).select("contour_id", "idx", "point_role")


SUMMARY = """summaries AS (SELECT p_partkey, CASE p_partkey % 5
    WHEN 0 THEN '{"selected_port": {"direction": "XMin", "point": [' || p_size || ', 4.5], "local_width": 3}}'
    WHEN 1 THEN '{"ports": ["x", {"port_side": "top", "center": [1, ' || p_size || '], "width": -1, "port_width": 2.5}], "side": "left"}'
    WHEN 2 THEN '{"patch_port_detection": {"ports": [{"side": "nowhere", "raw_endpoint": ["a", 2]}]}, "closest_border_sides": ["none", "y_max"], "closest_edge": [[0, 0], [' || p_size || ', 4]]}'
    WHEN 3 THEN '{"closest_edge": [[1, 1], [1.25, 1]], "feed_width": 0, "side": " Right "}'
    ELSE '{"patch_port_detection": {"selected_port": {"direction": "bottom", "cst_contact_point": [2, 3]}}, "width": ' || p_size || '}' END AS doc FROM part)"""


@register("resolve_port", f"""WITH {SUMMARY}, parts AS (SELECT p_partkey, doc::JSON AS d, CASE p_partkey % 5 WHEN 0 THEN doc::JSON -> '$.selected_port' WHEN 1 THEN doc::JSON -> '$.ports[1]'
      WHEN 2 THEN doc::JSON -> '$.patch_port_detection.ports[0]' WHEN 4 THEN doc::JSON -> '$.patch_port_detection.selected_port' END AS p FROM summaries)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'top' WHEN 2 THEN 'bottom' WHEN 3 THEN 'right' ELSE 'bottom' END AS side,
      CASE p_partkey % 5 WHEN 0 THEN (p ->> '$.point[0]')::DOUBLE WHEN 1 THEN (p ->> '$.center[0]')::DOUBLE WHEN 4 THEN (p ->> '$.cst_contact_point[0]')::DOUBLE
        ELSE ((d ->> '$.closest_edge[0][0]')::DOUBLE + (d ->> '$.closest_edge[1][0]')::DOUBLE) / 2 END AS port_x,
      CASE p_partkey % 5 WHEN 0 THEN (p ->> '$.point[1]')::DOUBLE WHEN 1 THEN (p ->> '$.center[1]')::DOUBLE WHEN 4 THEN (p ->> '$.cst_contact_point[1]')::DOUBLE
        ELSE ((d ->> '$.closest_edge[0][1]')::DOUBLE + (d ->> '$.closest_edge[1][1]')::DOUBLE) / 2 END AS port_y,
      round(CASE p_partkey % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 2.5 WHEN 3 THEN 1.0 WHEN 4 THEN (d ->> '$.width')::DOUBLE
        ELSE greatest(1.0, sqrt(((d ->> '$.closest_edge[1][0]')::DOUBLE) ** 2 + 16.0)) END, 6)::DOUBLE AS port_width FROM parts""")
def _(t):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    doc = (
        F.when(k == 0, F.concat(F.lit('{"selected_port": {"direction": "XMin", "point": ['), s, F.lit(', 4.5], "local_width": 3}}')))
        .when(k == 1, F.concat(F.lit('{"ports": ["x", {"port_side": "top", "center": [1, '), s, F.lit('], "width": -1, "port_width": 2.5}], "side": "left"}')))
        .when(k == 2, F.concat(F.lit('{"patch_port_detection": {"ports": [{"side": "nowhere", "raw_endpoint": ["a", 2]}]}, "closest_border_sides": ["none", "y_max"], "closest_edge": [[0, 0], ['), s, F.lit(", 4]]}")))
        .when(k == 3, F.lit('{"closest_edge": [[1, 1], [1.25, 1]], "feed_width": 0, "side": " Right "}'))
        .otherwise(F.concat(F.lit('{"patch_port_detection": {"selected_port": {"direction": "bottom", "cst_contact_point": [2, 3]}}, "width": '), s, F.lit("}")))
    )
    out = primitives.resolve_port(t.table("part").select("p_partkey", doc.alias("doc")), "doc")
    return out.withColumn("port_width", rounded(F.col("port_width")))


PORTS = """ports AS (SELECT design_id, side, CASE side WHEN 'left' THEN min_x - 5 WHEN 'right' THEN max_x + 150 ELSE (min_x + max_x) / 2 END AS port_x,
    CASE side WHEN 'top' THEN min_y - 2.5 WHEN 'bottom' THEN max_y + 7.5 ELSE (min_y + max_y) / 2 END AS port_y, 10.0::DOUBLE AS port_width FROM extents)"""


def ports(t):
    c = F.col
    return boxes(t).select(
        "design_id", "side",
        F.when(c("side") == "left", c("min_x") - 5).when(c("side") == "right", c("max_x") + 150).otherwise((c("min_x") + c("max_x")) / 2).alias("port_x"),
        F.when(c("side") == "top", c("min_y") - 2.5).when(c("side") == "bottom", c("max_y") + 7.5).otherwise((c("min_y") + c("max_y")) / 2).alias("port_y"),
        F.lit(10.0).alias("port_width"),
    )


@register("shift_inward", f"""WITH {PRIMS}, {PORTS}, o AS (SELECT *, (design_id % 3)::DOUBLE / 2 AS s FROM ports)
    SELECT design_id, port_x + CASE WHEN s > 0 AND side = 'left' THEN s WHEN s > 0 AND side = 'right' THEN -s ELSE 0.0 END AS x,
      port_y + CASE WHEN s > 0 AND side = 'top' THEN s WHEN s > 0 AND side = 'bottom' THEN -s ELSE 0.0 END AS y FROM o""")
def _(t):
    x, y = primitives.shift_inward(F.col("port_x"), F.col("port_y"), F.col("side"), (F.col("design_id") % 3).cast("double") / 2)
    return ports(t).select("design_id", x.alias("x"), y.alias("y"))


SEGMENT = """(CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 <= 1e-18 THEN sqrt((px - x1) ** 2 + (py - y1) ** 2) ELSE
    sqrt((px - (x1 + u * (x2 - x1))) ** 2 + (py - (y1 + u * (y2 - y1))) ** 2) END)"""
SHARE = "greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"


@register("distance_to_polyline", f"""WITH {PRIMS}, {PORTS}, m AS (SELECT design_id, px, py, x1, y1, x2, y2, {SHARE} AS u FROM
      (SELECT p.design_id, port_x AS px, port_y AS py, x1, y1, x2, y2 FROM ports p JOIN prims e ON p.design_id = e.design_id))
    SELECT design_id, round(min({SEGMENT}), 6) AS distance FROM m GROUP BY design_id""")
def _(t):
    points = ports(t).select("design_id", F.col("port_x").alias("px"), F.col("port_y").alias("py"))
    return primitives.distance_to_polyline(points, prims(t)).withColumn("distance", rounded(F.col("distance")))


@register("connect_port", f"""WITH {PRIMS}, {PORTS}, k AS (SELECT unnest(range(0, 601)) AS k),
    walk AS (SELECT design_id, k, port_x + CASE side WHEN 'left' THEN 1.0 WHEN 'right' THEN -1.0 ELSE 0.0 END * (k * 0.2::DOUBLE) AS px,
      port_y + CASE side WHEN 'top' THEN 1.0 WHEN 'bottom' THEN -1.0 ELSE 0.0 END * (k * 0.2::DOUBLE) AS py FROM ports, k WHERE side IS NOT NULL),
    near AS (SELECT w.design_id, k, px, py, x1, y1, x2, y2, {SHARE} AS u FROM walk w JOIN prims e ON w.design_id = e.design_id
      WHERE px BETWEEN least(x1, x2) - 0.2 AND greatest(x1, x2) + 0.2 AND py BETWEEN least(y1, y2) - 0.2 AND greatest(y1, y2) + 0.2),
    hit AS (SELECT design_id, min(k) AS k FROM near WHERE {SEGMENT} <= 0.15 GROUP BY design_id),
    done AS (SELECT p.*, h.k AS hit, coalesce(h.k, 600) * 0.2::DOUBLE AS s FROM ports p LEFT JOIN hit h ON p.design_id = h.design_id)
    SELECT design_id, CASE WHEN side IS NULL THEN 'failed_unknown_port_side' WHEN hit = 0 THEN 'already_connected' WHEN hit > 0 THEN 'connected_by_inward_shift'
      ELSE 'failed_no_curve_contact_within_max_shift' END AS status, CASE WHEN side IS NULL THEN 0.0 ELSE round(s, 6) END AS shift,
      round(port_x + CASE side WHEN 'left' THEN s WHEN 'right' THEN -s ELSE 0.0 END, 6) AS point_x,
      round(port_y + CASE side WHEN 'top' THEN s WHEN 'bottom' THEN -s ELSE 0.0 END, 6) AS point_y,
      CASE WHEN side IS NULL THEN 10.0 ELSE 15.0 END::DOUBLE AS width FROM done""")
def _(t):
    out = primitives.connect_port(ports(t), prims(t))
    return out.select("design_id", "status", *r("shift", "point_x", "point_y"), "width")


@register("feed_rules_score", """WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, l_quantity + l_linenumber AS d,
      l_extendedprice / 20000 AS e, 1 + l_discount * 5 AS f, l_quantity / 2 AS g, l_returnflag = 'A' AS h FROM lineitem),
    s AS (SELECT *, CASE WHEN b / greatest(a, 1e-6) < 0.35 THEN 2.0 ELSE -2.0 END AS s1, CASE WHEN d / greatest(c, 1e-6) < 2.0 THEN 1.5 ELSE -1.5 END AS s2,
      CASE WHEN e > 3 THEN 3.0 WHEN e < 1.5 THEN -3.0 ELSE 0.5 END AS s3, CASE WHEN f < 1.15 THEN 2.0 WHEN f > 1.4 THEN -2.5 ELSE 0.5 END AS s4,
      CASE WHEN h THEN 3.0 ELSE 0.0 END AS s5, CASE WHEN g < greatest(6.0, a * 1.2) THEN -2.0 ELSE 1.0 END AS s6 FROM f),
    t AS (SELECT *, (s1 + s2 + s3 + s4 + s5 + s6)::DOUBLE AS total FROM s)
    SELECT l_orderkey, l_linenumber, a AS mean_width, round(total, 3) AS total_score, total >= 1.0 AND e >= 1.0 AND g >= 3.0 AS em_valid,
      round(greatest(0.2, least(1.0, 0.55 + total / 12.0)), 3)::DOUBLE AS confidence_scale FROM t""")
def _(t):
    c = F.col
    rows = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", c("l_quantity").alias("mean_width"), (c("l_discount") * 100).alias("width_std"), (c("l_tax") * 100).alias("min_width"),
        (c("l_quantity") + c("l_linenumber")).alias("max_width"), (c("l_extendedprice") / 20000).alias("feed_aspect_ratio"),
        (1 + c("l_discount") * 5).alias("branch_tortuosity"), (c("l_quantity") / 2).alias("branch_length"),
        (c("l_returnflag") == "A").alias("patch_transition_detected"),
    )
    return primitives.feed_rules_score(rows).select("l_orderkey", "l_linenumber", "mean_width", "total_score", "em_valid", "confidence_scale")


def ends(t, scale=20.0):
    c = F.col
    point = lambda n, x, y: F.struct((c("idx") * 2 + n).alias("seq"), (c(x) * scale).alias("x"), (c(y) * scale).alias("y"))
    return t.primitives().select("design_id", F.inline(F.array(point(0, "x1", "y1"), point(1, "x2", "y2"))))


# Ends joined one by one; each cluster keeps its sums, size and first end.
@register("junctions", """WITH RECURSIVE ends AS (SELECT design_id, unnest([idx * 2, idx * 2 + 1]) AS seq, unnest([x1, x2]) * 40 AS x, unnest([y1, y2]) * 40 AS y FROM primitives),
    walk AS (SELECT design_id, -1::BIGINT AS seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, []::STRUCT(sx DOUBLE, sy DOUBLE, n BIGINT, head BIGINT)[] AS found, NULL::BIGINT AS junction FROM (SELECT DISTINCT design_id FROM ends)
      UNION ALL SELECT design_id, seq, x, y, CASE WHEN hit IS NULL THEN list_append(found, {'sx': x, 'sy': y, 'n': 1::BIGINT, 'head': seq})
        ELSE found[1:hit - 1] || [{'sx': found[hit].sx + x, 'sy': found[hit].sy + y, 'n': found[hit].n + 1, 'head': found[hit].head}] || found[hit + 1:] END,
        CASE WHEN hit IS NULL THEN seq ELSE found[hit].head END
      FROM (SELECT w.design_id, e.seq, e.x, e.y, found, nullif(list_position([sqrt((e.x - c.sx / c.n) ** 2 + (e.y - c.sy / c.n) ** 2) <= 1.0 FOR c IN found], true), 0) AS hit
        FROM walk w JOIN ends e ON e.design_id = w.design_id AND e.seq = w.seq + 1)),
    sized AS (SELECT design_id, junction, seq, avg(x) OVER w AS sx, avg(y) OVER w AS sy, count(*) OVER w AS members FROM walk WHERE seq >= 0 WINDOW w AS (PARTITION BY design_id, junction))
    SELECT design_id, junction, seq, round(sx, 6) + 0.0 AS shared_x, round(sy, 6) + 0.0 AS shared_y, members FROM sized WHERE members > 1""")
def _(t):
    return primitives.junctions(ends(t, 40.0), 1.0).select("design_id", "junction", "seq", *r("shared_x", "shared_y"), "members")


# Members grouped by whole-unit cells stand in for given junctions.
MEMBERS = """members AS (SELECT design_id, seq, x, y, floor(x / 2)::BIGINT * 100 + floor(y / 2)::BIGINT AS junction, CASE WHEN seq % 7 = 0 THEN 'PORT' ELSE 'STRUCTURAL' END AS role
    FROM (SELECT design_id, unnest([idx * 2, idx * 2 + 1]) AS seq, unnest([x1, x2]) * 20 AS x, unnest([y1, y2]) * 20 AS y FROM primitives))"""


def members(t):
    c = F.col
    half = lambda v: F.floor(c(v) / 2).cast("long")
    return ends(t).select(
        "design_id", "seq", "x", "y", (half("x") * 100 + half("y")).alias("junction"), F.when(c("seq") % 7 == 0, "PORT").otherwise("STRUCTURAL").alias("role")
    )


@register("sync_junctions", f"""WITH {MEMBERS}, m AS (SELECT design_id, junction, coalesce(avg(x) FILTER (role = 'PORT'), avg(x)) AS tx, coalesce(avg(y) FILTER (role = 'PORT'), avg(y)) AS ty
      FROM members GROUP BY design_id, junction)
    SELECT a.design_id, a.junction, a.seq, round(tx, 6) AS target_x, round(ty, 6) AS target_y FROM members a JOIN m ON a.design_id = m.design_id AND a.junction = m.junction""")
def _(t):
    return primitives.sync_junctions(members(t)).select("design_id", "junction", "seq", *r("target_x", "target_y"))


@register("broken_junctions", f"""WITH {MEMBERS}, m AS (SELECT design_id, junction, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM members GROUP BY design_id, junction),
    g AS (SELECT a.design_id, a.junction, max(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS max_gap FROM members a JOIN m ON a.design_id = m.design_id AND a.junction = m.junction
      WHERE n >= 2 GROUP BY a.design_id, a.junction)
    SELECT design_id, junction, round(max_gap, 6) AS max_gap FROM g WHERE max_gap > 0.7""")
def _(t):
    return primitives.broken_junctions(members(t), 0.7).withColumn("max_gap", rounded(F.col("max_gap")))


PLAN = ROLES + """, sized AS (SELECT r.*, greatest(10.0, sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2)) AS scale, abs(x2 - x1) AS w, abs(y2 - y1) AS h FROM roles r JOIN extents b ON r.design_id = b.design_id),
    plan AS (
      SELECT design_id, primitive_id, seq, 0 AS kind, unnest([0, 1, 2, 3]) AS part, unnest(['hole_translate_x', 'hole_translate_y', 'hole_resize_width', 'hole_resize_height']) AS variable_type,
        unnest([greatest(0.25, least(3.0, 0.04 * scale)), greatest(0.25, least(3.0, 0.04 * scale)), greatest(0.1, least(3.0, 0.5 * w)), greatest(0.1, least(3.0, 0.5 * h))]) AS hi, -1.0 AS f FROM sized WHERE type = 'HOLE'
      UNION ALL SELECT design_id, primitive_id, seq, 1, 0, 'line_normal_offset', CASE WHEN role = 'FEEDLINE' THEN 0.018::DOUBLE ELSE 0.018::DOUBLE * 1.25 END * scale, -1.0 FROM sized WHERE type = 'LINE' AND role <> 'PORT'
      UNION ALL SELECT design_id, primitive_id, seq, 2, unnest([0, 1]), unnest(['port_width_delta', 'port_propagation_shift']), unnest([0.2 * greatest(1.0, length), greatest(2.0, least(0.05 * greatest(1.0, length), 0.005 * scale))]), unnest([0.0, -1.0]) FROM sized WHERE type = 'LINE' AND role = 'PORT')"""


def plan(t):
    rows = roles(t).select(
        "design_id", "primitive_id", "seq", "type", "role", "length", F.least("x1", "x2").alias("min_x"), F.least("y1", "y2").alias("min_y"),
        F.greatest("x1", "x2").alias("max_x"), F.greatest("y1", "y2").alias("max_y"),
    )
    return primitives.variable_plan_primitives(rows, boxes(t))


@register("variable_plan_primitives", f"""WITH {PLAN}
    SELECT design_id, primitive_id, variable_type, round(hi * f, 6) + 0.0 AS lower, round(hi, 6) AS upper FROM plan""")
def _(t):
    return plan(t).select("design_id", "primitive_id", "variable_type", *r("lower", "upper"))


SLOTS = RECT + """, placed AS (SELECT s.design_id, 's' || slot_id AS slot_id, min(x - s.width / 2) AS min_x, min(y - height / 2) AS min_y, max(x + s.width / 2) AS max_x, max(y + height / 2) AS max_y
      FROM slots s GROUP BY s.design_id, slot_id),
    homes AS (SELECT p.*, CASE WHEN design_id % 3 = 0 THEN min_x - 1 END AS px0, CASE WHEN design_id % 3 = 0 THEN min_y - 2 END AS py0, CASE WHEN design_id % 3 = 0 THEN max_x + 3 END AS px1, CASE WHEN design_id % 3 = 0 THEN max_y - 1 END AS py1 FROM placed p),
    boards AS (SELECT design_id, 0.0::DOUBLE AS bx0, -3.0::DOUBLE AS by0, width AS bx1, length AS by1 FROM patch)"""


def slot_tables(t):
    c = F.col
    patch, slots, _ = rect_tables(t)
    placed = slots.groupBy("design_id", F.concat(F.lit("s"), "slot_id").alias("slot_id")).agg(
        F.min(c("x") - c("width") / 2).alias("min_x"), F.min(c("y") - c("height") / 2).alias("min_y"),
        F.max(c("x") + c("width") / 2).alias("max_x"), F.max(c("y") + c("height") / 2).alias("max_y"),
    )
    own = lambda v: F.when(c("design_id") % 3 == 0, v)
    homes = placed.select(
        "*", own(c("min_x") - 1).alias("parent_min_x"), own(c("min_y") - 2).alias("parent_min_y"),
        own(c("max_x") + 3).alias("parent_max_x"), own(c("max_y") - 1).alias("parent_max_y"),
    )
    boards = patch.select("design_id", F.lit(0.0).alias("min_x"), F.lit(-3.0).alias("min_y"), c("width").alias("max_x"), c("length").alias("max_y"))
    return homes, boards


@register("variable_plan_slots", f"""WITH {SLOTS}, j AS (SELECT h.design_id, slot_id, coalesce(px0, bx0) - min_x AS ax, coalesce(px1, bx1) - max_x AS bx, coalesce(py0, by0) - min_y AS ay, coalesce(py1, by1) - max_y AS b_y,
      greatest(1e-9, max_x - min_x) AS sx, greatest(1e-9, max_y - min_y) AS sy FROM homes h JOIN boards b ON h.design_id = b.design_id),
    v AS (SELECT design_id, slot_id || '_' || unnest(['dx', 'dy', 'length', 'width']) AS name,
      unnest([CASE WHEN ax > bx THEN (ax + bx) / 2 ELSE ax END, CASE WHEN ay > b_y THEN (ay + b_y) / 2 ELSE ay END, greatest(sx, sy) * 0.5, least(sx, sy) * 0.5]) AS lower,
      unnest([CASE WHEN ax > bx THEN (ax + bx) / 2 ELSE bx END, CASE WHEN ay > b_y THEN (ay + b_y) / 2 ELSE b_y END, greatest(sx, sy) * 1.5, least(sx, sy) * 1.5]) AS upper,
      unnest([0.0, 0.0, greatest(sx, sy), least(sx, sy)]) AS "default" FROM j)
    SELECT design_id, name, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper, round("default", 6) AS "default" FROM v
    UNION ALL SELECT design_id, unnest(['global_scale_x', 'global_scale_y']), 0.8::DOUBLE, 1.5::DOUBLE, 1.0::DOUBLE FROM boards""")
def _(t):
    return primitives.variable_plan_slots(*slot_tables(t)).select("design_id", "name", *r("lower", "upper", "default"))


@register("variable_groups", f"""WITH {PLAN}, v AS (SELECT design_id, kind * 1000 + seq * 10 + part AS o, primitive_id || variable_type AS name, variable_type, CASE WHEN kind = 0 THEN primitive_id END AS slot_id, CASE kind WHEN 0 THEN 'SLOT' WHEN 1 THEN 'unknown' ELSE 'PORT' END AS target FROM plan),
    g AS (SELECT design_id, o, name, unnest(['target', 'type', 'slot']) AS grouping, unnest([target, variable_type, slot_id]) AS value FROM v)
    SELECT design_id, grouping AS grouping_kind, value, string_agg(name, ',' ORDER BY o) AS names FROM g WHERE value IS NOT NULL GROUP BY design_id, grouping, value""")
def _(t):
    c = F.col
    rows = plan(t).select(
        "design_id", (c("kind") * 1000 + c("seq") * 10 + c("part")).alias("seq"), F.concat("primitive_id", "variable_type").alias("name"), "variable_type",
        F.when(c("kind") == 0, c("primitive_id")).alias("slot_id"), F.when(c("kind") == 0, "SLOT").when(c("kind") == 1, "").otherwise("PORT").alias("target"),
    )
    return primitives.variable_groups(rows).select("design_id", c("grouping").alias("grouping_kind"), "value", F.array_join("names", ",").alias("names"))


OUTLINE = RECT + """, outline AS (SELECT design_id, cx - width / 2 - 1 AS min_x, cy - length / 2 - 2 AS min_y, cx + width / 2 AS max_x, cy + length / 2 AS max_y FROM patch),
    fd AS (SELECT f.*, 3.0::DOUBLE AS length FROM feed f WHERE design_id % 4 <> 0),
    cut AS (SELECT o.design_id, f.direction, f.x AS fx, f.y AS fy, CASE WHEN direction = 'left' THEN f.x ELSE min_x END AS min_x, CASE WHEN direction = 'bottom' THEN f.y ELSE min_y END AS min_y,
      CASE WHEN direction = 'right' THEN f.x ELSE max_x END AS max_x, CASE WHEN direction = 'top' THEN f.y ELSE max_y END AS max_y FROM outline o LEFT JOIN fd f ON o.design_id = f.design_id)"""


def outline_tables(t):
    c = F.col
    patch, slots, feed = rect_tables(t)
    outline = patch.select(
        "design_id", (c("cx") - c("width") / 2 - 1).alias("min_x"), (c("cy") - c("length") / 2 - 2).alias("min_y"),
        (c("cx") + c("width") / 2).alias("max_x"), (c("cy") + c("length") / 2).alias("max_y"),
    )
    return outline, feed.filter(c("design_id") % 4 != 0).withColumn("length", F.lit(3.0)), slots


@register("design_summary", f"""WITH {OUTLINE}, s AS (SELECT design_id, count(*) AS n, sum(width * height) AS a FROM slots GROUP BY design_id)
    SELECT c.design_id, round(max_y - min_y, 6) + 0.0 AS length, round(max_x - min_x, 6) + 0.0 AS width, round((min_x + max_x) / 2, 6) + 0.0 AS center_x, round((min_y + max_y) / 2, 6) + 0.0 AS center_y,
      coalesce(direction, 'unknown') AS feed_direction, round(CASE WHEN direction IN ('top', 'bottom') THEN fx - (min_x + max_x) / 2 WHEN direction IN ('left', 'right') THEN fy - (min_y + max_y) / 2 END, 6) + 0.0 AS feed_offset,
      coalesce(n, 0) AS slot_count, round(coalesce(a, 0.0), 6) AS slot_area FROM cut c LEFT JOIN s ON c.design_id = s.design_id""")
def _(t):
    outline, feed, slots = outline_tables(t)
    out = primitives.design_summary(outline, feed, slots.withColumn("area", F.col("width") * F.col("height")))
    return out.drop("patch_area")


@register("electrical_size", """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS width, p_retailprice / 50 AS length, 1.0::DOUBLE + p_partkey % 9 AS f, CASE WHEN p_partkey % 4 <> 0 THEN 2.2::DOUBLE + p_partkey % 3 END AS e FROM part),
    l AS (SELECT *, 299792458.0::DOUBLE / (f * 1e9) * 1000 AS l0, 299792458.0::DOUBLE / (f * 1e9) * 1000 / sqrt(e) AS lg FROM p)
    SELECT p_partkey, round(l0, 6) AS lambda0, round(length / l0, 6) AS length_lambda0, round(width / l0, 6) AS width_lambda0, round(lg, 6) AS lambda_g,
      round(length / lg, 6) AS length_lambda_g, round(width / lg, 6) AS width_lambda_g FROM l""")
def _(t):
    k = F.col("p_partkey")
    rows = t.table("part").select(
        "p_partkey", F.col("p_size").cast("double").alias("width"), (F.col("p_retailprice") / 50).alias("length"),
        (F.lit(1.0) + k % 9).alias("target_freq"), F.when(k % 4 != 0, F.lit(2.2) + k % 3).alias("epsilon_r"),
    )
    return primitives.electrical_size(rows).drop("width", "length", "target_freq", "epsilon_r")


COMPS = """comps AS (SELECT p_partkey AS design_id, unnest([0, 1, 2, 3]) AS comp, unnest(['Substrate', CASE WHEN p_partkey % 3 = 0 THEN 'Main Patch' ELSE 'body' END, 'strip', 'feed spare']) AS name,
      unnest([CASE WHEN p_partkey % 3 = 1 THEN 'ground' ELSE NULL END, CASE WHEN p_partkey % 3 = 1 THEN 'PATCH' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN 'FeedLine' ELSE '' END, NULL]) AS role,
      unnest(['x', CASE WHEN p_partkey % 3 = 2 THEN 'patch_edge' ELSE 'x' END, CASE WHEN p_partkey % 2 = 1 THEN 'a_feed' ELSE 'x' END, 'x']) AS prole,
      unnest([-9.0, 0.0, CASE p_partkey % 5 WHEN 3 THEN -2.0 WHEN 4 THEN p_size::DOUBLE ELSE 1.0 END, 99.0])::DOUBLE AS min_x,
      unnest([-9.0, 0.0, CASE p_partkey % 5 WHEN 0 THEN -3.0 WHEN 1 THEN 5.0 WHEN 2 THEN 7.0 ELSE 1.0 END, 99.0])::DOUBLE AS min_y,
      unnest([90.0, p_size::DOUBLE, CASE p_partkey % 5 WHEN 3 THEN 0.0 WHEN 4 THEN p_size::DOUBLE + 4 ELSE 3.0 END, 100.0])::DOUBLE AS max_x,
      unnest([90.0, 5.0, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 6.0 WHEN 2 THEN 8.0 ELSE 4.0 END, 100.0])::DOUBLE AS max_y FROM part)"""


def pick(value, cases, default):
    """CASE over a small dictionary of literals or columns."""
    chain = F
    for key, result in cases.items():
        chain = chain.when(value == key, result)
    return chain.otherwise(default)


def comps(t):
    c = F.col
    k, size = c("p_partkey"), c("p_size").cast("double")
    m = k % 5
    entry = lambda comp, name, role, prole, x0, y0, x1, y1: F.struct(
        F.lit(comp).alias("comp"), name.alias("name"), role.cast("string").alias("role"), F.array(prole).alias("primitive_roles"),
        x0.cast("double").alias("min_x"), y0.cast("double").alias("min_y"), x1.cast("double").alias("max_x"), y1.cast("double").alias("max_y"),
    )
    lit = F.lit
    return t.table("part").select(k.alias("design_id"), F.inline(F.array(
        entry(0, lit("Substrate"), F.when(k % 3 == 1, "ground"), lit("x"), lit(-9.0), lit(-9.0), lit(90.0), lit(90.0)),
        entry(1, F.when(k % 3 == 0, "Main Patch").otherwise("body"), F.when(k % 3 == 1, "PATCH").otherwise(""),
              F.when(k % 3 == 2, "patch_edge").otherwise("x"), lit(0.0), lit(0.0), size, lit(5.0)),
        entry(2, lit("strip"), F.when(k % 2 == 0, "FeedLine").otherwise(""), F.when(k % 2 == 1, "a_feed").otherwise("x"),
              pick(m, {3: -2.0, 4: size}, 1.0), pick(m, {0: -3.0, 1: 5.0, 2: 7.0}, 1.0),
              pick(m, {3: 0.0, 4: size + 4}, 3.0), pick(m, {0: 0.0, 1: 6.0, 2: 8.0}, 4.0)),
        entry(3, lit("feed spare"), lit(None), lit("x"), lit(99.0), lit(99.0), lit(100.0), lit(100.0)),
    )))


@register("infer_feed", f"""WITH {COMPS}, p AS (SELECT * FROM comps WHERE comp = 1), f AS (SELECT * FROM comps WHERE comp = 2),
    s AS (SELECT p.design_id, p.min_x AS a0, p.min_y AS b0, p.max_x AS a1, p.max_y AS b1, f.min_x AS c0, f.min_y AS d0, f.max_x AS c1, f.max_y AS d1,
      CASE p.design_id % 5 WHEN 0 THEN 'bottom' WHEN 1 THEN 'top' WHEN 3 THEN 'left' WHEN 4 THEN 'right' END AS side0 FROM p JOIN f ON p.design_id = f.design_id),
    q AS (SELECT *, CASE WHEN abs(d1 - b0) <= 1e-7 THEN 'bottom' WHEN abs(d0 - b0) <= 1e-7 AND c1 > a0 AND c0 < a1 THEN 'bottom' WHEN abs(d0 - b1) <= 1e-7 THEN 'top'
      WHEN abs(d1 - b1) <= 1e-7 AND c1 > a0 AND c0 < a1 THEN 'top' WHEN abs(c1 - a0) <= 1e-7 THEN 'left' WHEN abs(c0 - a0) <= 1e-7 AND d1 > b0 AND d0 < b1 THEN 'left'
      WHEN abs(c0 - a1) <= 1e-7 THEN 'right' WHEN abs(c1 - a1) <= 1e-7 AND d1 > b0 AND d0 < b1 THEN 'right' END AS side FROM s),
    o AS (SELECT *, CASE WHEN side IN ('bottom', 'top') THEN greatest(c0, a0) ELSE greatest(d0, b0) END AS lo, CASE WHEN side IN ('bottom', 'top') THEN least(c1, a1) ELSE least(d1, b1) END AS hi FROM q)
    SELECT design_id, CASE WHEN hi > lo THEN side END AS direction, CASE WHEN side IS NOT NULL AND hi > lo THEN CASE WHEN side IN ('bottom', 'top') THEN (lo + hi) / 2 WHEN side = 'left' THEN a0 ELSE a1 END END AS x,
      CASE WHEN side IS NOT NULL AND hi > lo THEN CASE side WHEN 'bottom' THEN b0 WHEN 'top' THEN b1 ELSE (lo + hi) / 2 END END AS y, CASE WHEN side IS NOT NULL AND hi > lo THEN hi - lo END AS width,
      CASE WHEN side IS NOT NULL AND hi > lo THEN greatest(0.0, CASE side WHEN 'bottom' THEN b0 - d0 WHEN 'top' THEN d1 - b1 WHEN 'left' THEN a0 - c0 ELSE c1 - a1 END) END AS length FROM o""")
def _(t):
    return primitives.infer_feed(comps(t))


@register("port_from_feed", f"""WITH {OUTLINE}, j AS (SELECT o.*, f.direction, f.width AS fw, f.design_id IS NOT NULL AS fed, CASE WHEN f.design_id % 3 = 1 THEN f.x + 0.5 ELSE f.x END AS fx, f.y AS fy FROM outline o LEFT JOIN fd f ON o.design_id = f.design_id),
    p AS (SELECT design_id, CASE WHEN fed THEN direction ELSE 'bottom' END AS direction, CASE WHEN fed THEN greatest(2.0, fw) ELSE greatest(2.0, (max_x - min_x) * 0.08) END AS width,
      CASE WHEN fed THEN fx ELSE (min_x + max_x) / 2 END AS port_x, CASE WHEN fed THEN fy ELSE min_y END AS port_y, CASE WHEN fed THEN 'feed' ELSE 'synthetic_bottom_edge_center' END AS source FROM j)
    SELECT design_id, direction, round(width, 6) AS width, port_x, port_y, source, round(port_x - CASE WHEN direction IN ('top', 'bottom') THEN width / 2 ELSE 0 END, 6) + 0.0 AS edge_x1,
      round(port_y + CASE WHEN direction IN ('top', 'bottom') THEN 0 ELSE width / 2 END, 6) + 0.0 AS edge_y2 FROM p""")
def _(t):
    outline, feed, _ = outline_tables(t)
    fed = feed.withColumn("terminal_x", F.when(F.col("design_id") % 3 == 1, F.col("x") + 0.5)).withColumn("terminal_y", F.lit(None).cast("double"))
    out = primitives.port_from_feed(outline, fed)
    return out.select("design_id", "direction", *r("width"), "port_x", "port_y", "source", *r("edge_x1", "edge_y2"))


@register("edge_of_point", f"""WITH {RECT}, b AS (SELECT f.*, cx - p.width / 2 AS l, cx + p.width / 2 AS r, cy - length / 2 AS bt, cy + length / 2 AS tp FROM feed f JOIN patch p ON f.design_id = p.design_id)
    SELECT design_id, CASE WHEN abs(y - bt) <= 1e-7 AND x BETWEEN l - 1e-7 AND r + 1e-7 THEN 'bottom' WHEN abs(y - tp) <= 1e-7 AND x BETWEEN l - 1e-7 AND r + 1e-7 THEN 'top'
      WHEN abs(x - l) <= 1e-7 AND y BETWEEN bt - 1e-7 AND tp + 1e-7 THEN 'left' WHEN abs(x - r) <= 1e-7 AND y BETWEEN bt - 1e-7 AND tp + 1e-7 THEN 'right' END AS edge FROM b""")
def _(t):
    c = F.col
    patch, _, feed = rect_tables(t)
    rows = feed.select("design_id", "x", "y").join(patch, "design_id")
    edge = validate.edge_of_point(
        c("x"), c("y"), c("cx") - c("width") / 2, c("cy") - c("length") / 2, c("cx") + c("width") / 2, c("cy") + c("length") / 2
    )
    return rows.select("design_id", edge.alias("edge"))


@register("edge_clearance", f"""WITH {ROLES}, board AS (SELECT design_id, 40.0::DOUBLE AS width, (20 + design_id % 30)::DOUBLE AS height FROM extents),
    pts AS (SELECT r.design_id, r.primitive_id, role, unnest([x1, x2]) + 20 AS x, unnest([y1, y2]) + 15 AS y, seq % 2 = 0 AS corridor FROM roles r),
    m AS (SELECT p.design_id, primitive_id, any_value(role) AS role, bool_or(corridor) AS corridor, min(least(x, width - x, y, height - y)) AS clearance, any_value(greatest(10.0, 0.02 * least(width, height))) AS required
      FROM pts p JOIN board b ON p.design_id = b.design_id GROUP BY p.design_id, primitive_id)
    SELECT design_id, primitive_id, round(clearance, 6) AS clearance, role = 'PORT' OR (role = 'FEEDLINE' AND corridor) AS exempt,
      NOT (role = 'PORT' OR (role = 'FEEDLINE' AND corridor)) AND clearance < required AS violation FROM m""")
def _(t):
    from sweepfield.operators import contours

    c = F.col
    point = lambda x, y: F.struct((c(x) + 20).alias("x"), (c(y) + 15).alias("y"))
    points = roles(t).select(
        "design_id", "primitive_id", "role", (c("seq") % 2 == 0).alias("in_corridor"), F.inline(F.array(point("x1", "y1"), point("x2", "y2")))
    )
    board = boxes(t).select("design_id", F.lit(40.0).alias("width"), (20 + c("design_id") % 30).cast("double").alias("height"))
    out = contours.edge_clearance(points, board)
    return out.select("design_id", "primitive_id", *r("clearance"), "exempt", "violation")
