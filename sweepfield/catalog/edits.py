"""Queries over geometry edits."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import r
from sweepfield.catalog.primitives import SLOTS, slot_tables
from sweepfield.catalog.registry import register
from sweepfield.catalog.validation import RECT, rect_tables
from sweepfield.operators import edits

OPS = ["translate", "rotate", "scale", "mirror_x", "mirror_y"]


@register("affine", f"""WITH e AS (SELECT *, {OPS}[1 + contour_id % 5] AS op, radians(angle) AS a, 0.1::DOUBLE AS cx, -0.05::DOUBLE AS cy FROM edits WHERE contour_id % 11 <> 0),
    j AS (SELECT c.contour_id, c.idx, c.x, c.y, op, dx, dy, a, factor, c.x - cx AS rx, c.y - cy AS ry, cx, cy FROM contours c LEFT JOIN e ON c.contour_id = e.contour_id)
    SELECT contour_id, idx, round(CASE op WHEN 'translate' THEN x + dx WHEN 'rotate' THEN cx + rx * cos(a) - ry * sin(a) WHEN 'scale' THEN cx + rx * factor WHEN 'mirror_y' THEN 2 * cx - x ELSE x END, 6) + 0.0 AS x,
      round(CASE op WHEN 'translate' THEN y + dy WHEN 'rotate' THEN cy + rx * sin(a) + ry * cos(a) WHEN 'scale' THEN cy + ry * factor WHEN 'mirror_x' THEN 2 * cy - y ELSE y END, 6) + 0.0 AS y FROM j""")
def _(t):
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.col("contour_id") % 5 + 1).cast("int"))
    table = t.edits().filter(F.col("contour_id") % 11 != 0).select("*", op.alias("op"), F.lit(0.1).alias("cx"), F.lit(-0.05).alias("cy"))
    return edits.affine(t.contours(), table).select("contour_id", "idx", *r("x", "y"))


@register("resize_patch", f"""WITH {RECT}, e AS (SELECT design_id, CASE WHEN design_id % 2 = 0 THEN width * 1.5 END AS nw, CASE WHEN design_id % 3 <> 0 THEN length + 2 END AS nl FROM patch WHERE design_id % 7 <> 0),
    p AS (SELECT p.design_id, cx, cy, coalesce(nw, p.width) AS w, coalesce(nl, p.length) AS l, f.x AS fx, f.y AS fy, f.width AS fw, 3.0::DOUBLE AS fl, direction FROM patch p LEFT JOIN e ON p.design_id = e.design_id LEFT JOIN feed f ON p.design_id = f.design_id),
    q AS (SELECT *, cx - w / 2 AS x0, cx + w / 2 AS x1, cy - l / 2 AS y0, cy + l / 2 AS y1 FROM p),
    s AS (SELECT *, CASE direction WHEN 'left' THEN x0 WHEN 'right' THEN x1 ELSE least(greatest(fx, x0 + fw / 2), x1 - fw / 2) END AS nx,
      CASE direction WHEN 'bottom' THEN y0 WHEN 'top' THEN y1 ELSE least(greatest(fy, y0 + fw / 2), y1 - fw / 2) END AS ny FROM q)
    SELECT design_id, w AS width, l AS length, nx AS feed_x, ny AS feed_y,
      greatest(0.0, CASE direction WHEN 'bottom' THEN ny - (fy - fl) WHEN 'top' THEN fy + fl - ny WHEN 'left' THEN nx - (fx - fl) ELSE fx + fl - nx END) AS feed_length FROM s""")
def _(t):
    d = F.col("design_id")
    patch, _, feed = rect_tables(t)
    wanted = patch.filter(d % 7 != 0).select(
        "design_id", F.when(d % 2 == 0, F.col("width") * 1.5).alias("width"), F.when(d % 3 != 0, F.col("length") + 2).alias("length")
    )
    out = edits.resize_patch(patch, feed.withColumn("length", F.lit(3.0)), wanted)
    return out.select("design_id", "width", "length", "feed_x", "feed_y", "feed_length")


@register("edit_slots", f"""WITH {SLOTS} SELECT design_id, slot_id, min_x, max_x FROM placed WHERE NOT (design_id % 4 = 0 AND slot_id = 's1')
    UNION ALL SELECT design_id, 'added', 0.25::DOUBLE, 0.75::DOUBLE FROM patch WHERE design_id % 5 = 0""")
def _(t):
    d = F.col("design_id")
    slots = slot_tables(t)[0].select("design_id", "slot_id", "min_x", "max_x")
    gone = slots.filter((d % 4 == 0) & (F.col("slot_id") == "s1"))
    new = rect_tables(t)[0].filter(d % 5 == 0).select("design_id", F.lit("added").alias("slot_id"), F.lit(0.25).alias("min_x"), F.lit(0.75).alias("max_x"))
    return edits.edit_slots(slots, gone, new)


OFFSETS = """o AS (SELECT contour_id, idx AS point_id, (idx % 5 - 2)::DOUBLE / 10 AS dx, (contour_id % 3)::DOUBLE / 20 AS dy FROM contours WHERE (contour_id + idx) % 4 <> 0),
    m AS (SELECT c.contour_id, c.idx, x, y, greatest(-0.1, least(coalesce(dx, 0.0), 0.15)) AS dx, greatest(CASE WHEN c.idx = 3 THEN 0.02 ELSE 0.0 END, least(coalesce(dy, 0.0), 0.05)) AS dy,
      ['RESONANT', 'FEEDLINE', 'STRUCTURAL', 'PORT'][1 + c.idx % 4] AS point_class FROM contours c LEFT JOIN o ON c.contour_id = o.contour_id AND c.idx = o.point_id)"""


def moved(t):
    i = F.col("idx")
    kinds = F.array(*[F.lit(k) for k in ("RESONANT", "FEEDLINE", "STRUCTURAL", "PORT")])
    points = t.contours().select(
        "contour_id", i.alias("point_id"), "x", "y", F.lit(-0.1).alias("dx_low"), F.lit(0.15).alias("dx_high"),
        F.when(i == 3, 0.02).otherwise(0.0).alias("dy_low"), F.lit(0.05).alias("dy_high"), F.element_at(kinds, (i % 4 + 1).cast("int")).alias("point_class"),
    )
    offsets = t.contours().filter((F.col("contour_id") + i) % 4 != 0).select(
        "contour_id", i.alias("point_id"), ((i % 5 - 2).cast("double") / 10).alias("dx"), ((F.col("contour_id") % 3).cast("double") / 20).alias("dy")
    )
    return edits.apply_offsets(points, offsets)


@register("apply_offsets", f"WITH {OFFSETS} SELECT contour_id, idx AS point_id, round(x + dx, 6) + 0.0 AS x, round(y + dy, 6) + 0.0 AS y, dx <> 0 OR dy <> 0 AS moved FROM m")
def _(t):
    return moved(t).select("contour_id", "point_id", *r("x", "y"), F.col("moved_x").isNotNull().alias("moved"))


@register("displacement_stats", f"""WITH {OFFSETS}, d AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN sqrt(dx * dx + dy * dy) END AS s FROM m)
    SELECT contour_id, count(*) AS selected_points, round(coalesce(avg(s), 0.0), 6) AS mean_displacement, round(coalesce(max(s), 0.0), 6) AS max_displacement, round(coalesce(min(s), 0.0), 6) AS min_displacement,
      count(*) FILTER (point_class = 'RESONANT') AS resonant_points, count(*) FILTER (point_class = 'FEEDLINE') AS feedline_points, count(*) FILTER (point_class = 'STRUCTURAL') AS structural_points, count(s) AS moved_points
    FROM d GROUP BY contour_id""")
def _(t):
    out = edits.displacement_stats(moved(t))
    return out.select("contour_id", "selected_points", *r("mean_displacement", "max_displacement", "min_displacement"), "resonant_points", "feedline_points", "structural_points", "moved_points")


@register("gaussian_deform", """WITH s AS (SELECT contour_id, greatest(1e-6, 2 * avg(d)) AS sigma FROM (SELECT contour_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY idx)) GROUP BY contour_id),
    m AS (SELECT e.contour_id, dx, dy, CASE WHEN e.contour_id % 2 = 0 THEN (e.contour_id % 40) ELSE 16 END AS ci FROM edits e),
    c AS (SELECT m.contour_id, dx, dy, x AS cx, y AS cy FROM m JOIN contours p ON p.contour_id = m.contour_id AND p.idx = least(31, ci)),
    w AS (SELECT p.contour_id, idx, x, y, dx, dy, CASE WHEN idx IN (0, 31) THEN 0.0 ELSE exp(-((x - cx) ** 2 + (y - cy) ** 2) / (sigma * sigma)) * CASE WHEN idx IN (1, 30) THEN 0.55 ELSE 1.0 END END AS wt
      FROM contours p JOIN c ON p.contour_id = c.contour_id JOIN s ON p.contour_id = s.contour_id)
    SELECT contour_id, idx, round(x + wt * dx, 6) + 0.0 AS x, round(y + wt * dy, 6) + 0.0 AS y, round(wt, 6) + 0.0 AS weight FROM w""")
def _(t):
    c = F.col("contour_id")
    moves = t.edits().select("contour_id", F.when(c % 2 == 0, c % 40).alias("center_index"), "dx", "dy")
    return edits.gaussian_deform(t.contours(), moves, t.spans("contours")).select("contour_id", "idx", *r("x", "y", "weight"))


@register("slot_value_mapping", f"""WITH {SLOTS}, h AS (SELECT *, 1.0::DOUBLE + design_id % 3 * 0.1::DOUBLE AS kx, 0.9::DOUBLE AS ky, CASE WHEN design_id % 2 = 0 THEN 2.0::DOUBLE END AS vl, CASE WHEN design_id % 5 = 0 THEN 1.0::DOUBLE END AS vd,
      greatest(1e-9, max_x - min_x) AS sx, greatest(1e-9, max_y - min_y) AS sy FROM homes),
    g AS (SELECT *, 1 + (min_x - 1) * kx AS a, 1 + (max_x - 1) * kx AS b, 2 + (min_y - 2) * ky AS c, 2 + (max_y - 2) * ky AS d, 1 + (px0 - 1) * kx AS pa, 1 + (px1 - 1) * kx AS pb, 2 + (py0 - 2) * ky AS pc, 2 + (py1 - 2) * ky AS pd,
      coalesce(vl, greatest(sx, sy)) AS len, least(sx, sy) AS wid FROM h),
    q AS (SELECT *, CASE WHEN sx >= sy THEN len ELSE wid END AS wx, CASE WHEN sx >= sy THEN wid ELSE len END AS wy FROM g),
    z AS (SELECT *, pa + 0.5 * greatest(1e-9, wx) - (a + b) / 2 AS lx, pb - 0.5 * greatest(1e-9, wx) - (a + b) / 2 AS hx, pc + 0.5 * greatest(1e-9, wy) - (c + d) / 2 AS ly, pd - 0.5 * greatest(1e-9, wy) - (c + d) / 2 AS hy FROM q)
    SELECT design_id, slot_id, round(CASE WHEN lx > hx THEN (lx + hx) / 2 ELSE greatest(lx, least(coalesce(vd, 0.0), hx)) END, 6) + 0.0 AS translate_x,
      round(CASE WHEN ly > hy THEN (ly + hy) / 2 ELSE greatest(ly, least(coalesce(vd, 0.0), hy)) END, 6) + 0.0 AS translate_y,
      round(wx - greatest(1e-9, b - a), 6) + 0.0 AS width_delta, round(wy - greatest(1e-9, d - c), 6) + 0.0 AS height_delta FROM z""")
def _(t):
    c = F.col
    sx, sy = F.greatest(F.lit(1e-9), c("max_x") - c("min_x")), F.greatest(F.lit(1e-9), c("max_y") - c("min_y"))
    slots = slot_tables(t)[0].select(
        "*", F.greatest(sx, sy).alias("length"), F.least(sx, sy).alias("width"), F.when(sx >= sy, "x").otherwise("y").alias("length_axis")
    )
    d = c("design_id")
    push = F.when(d % 5 == 0, F.lit(1.0))
    values = slots.select(
        "design_id", "slot_id", (F.lit(1.0) + d % 3 * 0.1).alias("scale_x"), F.lit(0.9).alias("scale_y"), F.lit(1.0).alias("cx"), F.lit(2.0).alias("cy"),
        F.when(d % 2 == 0, F.lit(2.0)).alias("length"), F.lit(None).cast("double").alias("width"), push.alias("dx"), push.alias("dy"),
    )
    out = edits.slot_value_mapping(slots, values)
    return out.select("design_id", "slot_id", *r("translate_x", "translate_y", "width_delta", "height_delta"))


def frames(t):
    v = F.col("vec_id")
    return t.table("embeddings").select(
        v.alias("contour_id"), (v % 9).cast("double").alias("height"), F.when(v % 2 == 0, 0.5).alias("origin_x"), (v % 3).cast("double").alias("origin_y")
    )


@register("frame_conversion", """SELECT contour_id, idx, round(x + CASE WHEN contour_id % 2 = 0 THEN 0.5 ELSE 0.0 END, 6) + 0.0 AS x,
    round((contour_id % 9)::DOUBLE - y + (contour_id % 3)::DOUBLE, 6) + 0.0 AS y, round(x, 6) + 0.0 AS back_x, round(y, 6) + 0.0 AS back_y FROM contours""")
def _(t):
    there = edits.to_geometry_frame(t.contours(), frames(t))
    back = edits.to_image_frame(there, frames(t)).select("contour_id", "idx", F.col("x").alias("back_x"), F.col("y").alias("back_y"))
    return there.join(back, ["contour_id", "idx"]).select("contour_id", "idx", *r("x", "y", "back_x", "back_y"))


def hash_sql(*parts):
    state = "12345::BIGINT"
    for part in parts:
        state = f"((({state}) + ({part}) % 2147483647) % 2147483647 * 48271 + 11) % 2147483647"
    return f"(({state}) / 2147483647.0::DOUBLE)"


@register("random_variants", f"""WITH p AS (SELECT contour_id, idx, x * 1000 AS x, y * 1000 AS y FROM contours),
    s AS (SELECT contour_id, floor(floor((max(x) - min(x)) * 0.05) / 2) AS hx, floor(floor((max(y) - min(y)) * 0.05) / 2) AS hy FROM p GROUP BY contour_id),
    c AS (SELECT p.*, hx, hy, epoch FROM p JOIN s ON p.contour_id = s.contour_id, (SELECT unnest(range(1, 4)) AS epoch)),
    k AS (SELECT *, row_number() OVER (PARTITION BY contour_id, epoch ORDER BY {hash_sql('9', '1', 'contour_id', 'epoch', 'idx')}, idx) AS k FROM c)
    SELECT contour_id, epoch::BIGINT AS epoch, idx, round(x + CASE WHEN k <= 25 THEN floor({hash_sql('9', '2', 'contour_id', 'epoch', 'idx')} * 2 * hx) - hx ELSE 0 END, 6) + 0.0 AS x,
      round(y + CASE WHEN k <= 25 THEN floor({hash_sql('9', '3', 'contour_id', 'epoch', 'idx')} * 2 * hy) - hy ELSE 0 END, 6) + 0.0 AS y, k <= 25 AS moved FROM k""")
def _(t):
    points = t.contours().select("contour_id", "idx", (F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y"))
    out = edits.random_variants(points, 3, seed=9, spans=t.spans("contours"))
    return out.select("contour_id", F.col("epoch").cast("long").alias("epoch"), "idx", *r("x", "y"), "moved")
