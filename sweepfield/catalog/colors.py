"""Queries over pixels."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import r
from sweepfield.catalog.registry import register
from sweepfield.functions.numeric import rounded
from sweepfield.operators import colors

HSV = """hs0 AS (SELECT image_id, px, py, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, greatest(r, g, b)::BIGINT AS v, (greatest(r, g, b) - least(r, g, b))::BIGINT AS d FROM pixels),
    hs1 AS (SELECT *, CASE WHEN d > 0 THEN floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END * round_even(737280.0::DOUBLE / (6 * d), 0) + 2048) / 4096)::BIGINT ELSE 0 END AS h0,
      CASE WHEN v > 0 THEN floor((d * round_even(1044480.0::DOUBLE / v, 0) + 2048) / 4096)::BIGINT ELSE 0 END AS s FROM hs0),
    hsv AS (SELECT image_id, px, py, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h, s, v FROM hs1)"""
NAMES = list(dict.fromkeys(n for n, _, _ in colors.COLOR_RANGES))
RANGES = "ranges(name, h0, s0, v0, h1, s1, v1) AS (VALUES " + ", ".join(
    f"('{n}', {a[0]}, {a[1]}, {a[2]}, {b[0]}, {b[1]}, {b[2]})" for n, a, b in colors.COLOR_RANGES
) + f"), names AS (SELECT unnest({NAMES}) AS name, unnest(range(0, {len(NAMES)})) AS rank)"
LABELS = f"{HSV}, {RANGES}, hits AS (SELECT DISTINCT image_id, px, py, name AS color FROM hsv JOIN ranges ON h BETWEEN h0 AND h1 AND s BETWEEN s0 AND s1 AND v BETWEEN v0 AND v1)"
SHARES = f"""{LABELS}, totals AS (SELECT image_id, count(*) AS n FROM pixels GROUP BY image_id), found AS (SELECT image_id, color, count(*) AS area FROM hits GROUP BY image_id, color),
    shares AS (SELECT t.image_id, rank, name AS color, coalesce(area, 0) AS area, coalesce(area, 0)::DOUBLE / n * 100 AS percentage FROM totals t CROSS JOIN names LEFT JOIN found f ON f.image_id = t.image_id AND f.color = name),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY percentage DESC, rank) AS place FROM shares WHERE percentage >= 1)"""


@register("rgb_to_hsv", f"WITH {HSV} SELECT image_id, px, py, h, s, v FROM hsv")
def _(t):
    return colors.rgb_to_hsv(t.pixels()).select("image_id", "px", "py", "h", "s", F.col("v").cast("long").alias("v"))


@register("label_colors", f"WITH {LABELS} SELECT image_id, px, py, color FROM hits")
def _(t):
    return colors.label_colors(t.pixels())


@register("color_shares", f"WITH {SHARES} SELECT image_id, color, area, round(percentage, 6) AS percentage FROM shares")
def _(t):
    return colors.color_shares(t.pixels()).select("image_id", "color", "area", *r("percentage"))


@register("dominant_colors", f"WITH {SHARES} SELECT image_id, place, color, round(percentage, 6) AS percentage FROM ranked WHERE place <= 3")
def _(t):
    out = colors.dominant_colors(colors.color_shares(t.pixels()))
    return out.select("image_id", F.col("place").cast("long").alias("place"), "color", *r("percentage"))


@register("solid_material", f"""WITH {SHARES}, top AS (SELECT image_id, arg_min(color, place) AS color FROM ranked WHERE place <= 2 AND color <> 'black' GROUP BY image_id)
    SELECT image_id, color, CASE color WHEN 'gray' THEN 'PEC' WHEN 'blue' THEN 'FR4' WHEN 'purple' THEN 'air' END AS material, color = 'gray' AS keep FROM top""")
def _(t):
    table = t.spark.createDataFrame([("gray", "PEC"), ("blue", "FR4"), ("purple", "air")], "color string, material string")
    return colors.solid_material(t.pixels(), table)


@register("quantize_colors")
def _(t):
    out = colors.quantize_colors(t.pixels())
    return out.groupBy("image_id", "cluster", "palette").agg(F.count(F.lit(1)).alias("pixels"))


# Clusters by brightness band stand in for a finished clustering.
CLUSTERED = """cl AS (SELECT image_id, px, py, r, g, b, ((r + g + b) // 100)::BIGINT AS cluster FROM pixels),
    cw AS (SELECT image_id, cluster, px, py, px AS rx, py AS ry FROM cl UNION SELECT f.image_id, f.cluster, f.px, f.py, w.rx, w.ry FROM cw w
      JOIN cl f ON f.image_id = w.image_id AND f.cluster = w.cluster AND abs(f.px - w.px) <= 1 AND abs(f.py - w.py) <= 1),
    comps AS (SELECT image_id, cluster, count(DISTINCT spot) AS comp_count FROM (SELECT image_id, cluster, min((rx, ry)) AS spot FROM cw GROUP BY image_id, cluster, px, py) AS o GROUP BY image_id, cluster),
    part AS (SELECT image_id, cluster, count(*) AS area, count(*) FILTER (px < 2 OR px > 4 OR py < 2 OR py > 0) AS hits, avg(r) AS r, avg(g) AS g, avg(b) AS b,
      (max(px) - min(px) + 1) * (max(py) - min(py) + 1) AS box FROM cl GROUP BY image_id, cluster),
    whole AS (SELECT image_id, sum(hits) AS border, sum(area) AS total, 200.0::DOUBLE + image_id % 56 AS bg FROM part GROUP BY image_id),
    stats AS (SELECT p.image_id, p.cluster, area, area / total AS area_ratio, hits / greatest(1, border) AS border_ratio, area / greatest(1, box) AS fill_ratio,
      sqrt(r * r + g * g + b * b) AS dist_black, sqrt((r - 255) ** 2 + (g - 255) ** 2 + (b - 255) ** 2) AS dist_white, sqrt((r - bg) ** 2 + (g - bg) ** 2 + (b - bg) ** 2) AS dist_bg,
      sqrt(3 * (bg - 255) ** 2) AS bg_white, comp_count FROM part p JOIN whole w ON p.image_id = w.image_id JOIN comps c ON p.image_id = c.image_id AND p.cluster = c.cluster)"""


def clustered(t):
    c = F.col
    rows = t.pixels().select("*", F.floor((c("r") + c("g") + c("b")) / 100).cast("long").alias("cluster"))
    level = F.lit(200.0) + c("image_id") % 56
    known = t.table("embeddings").select(c("vec_id").alias("image_id")).select("image_id", *[level.alias(f"bg_{n}") for n in "rgb"])
    return colors.cluster_stats(rows, known)


@register("cluster_stats", f"""WITH RECURSIVE {CLUSTERED} SELECT image_id, cluster, area, round(area_ratio, 6) AS area_ratio, round(border_ratio, 6) AS border_ratio, round(fill_ratio, 6) AS fill_ratio,
    round(dist_black, 5) AS dist_black, round(dist_white, 5) AS dist_white, round(dist_bg, 5) AS dist_bg, comp_count FROM stats""")
def _(t):
    return clustered(t).select(
        "image_id", "cluster", "area", *r("area_ratio", "border_ratio", "fill_ratio"), *r("dist_black", "dist_white", "dist_bg", digits=5), "comp_count"
    )


def first_max(score, among):
    """SQL: number of the cluster with the highest score among those flagged; the smallest on ties."""
    return f"arg_max(cluster, ({score}, -cluster)) FILTER ({among}) OVER (PARTITION BY image_id)"


@register("cluster_roles", f"""WITH RECURSIVE {CLUSTERED},
    s0 AS (SELECT *, 0.62 * (1 - least(1.0, dist_white / 160)) + 0.26 * border_ratio + 0.12 * (1 - least(1.0, area_ratio / 0.9::DOUBLE)) AS ps,
      0.54 * (1 - least(1.0, dist_bg / 180)) + 0.16 * border_ratio + 0.16 * least(1.0, dist_black / 150) + 0.14 * least(1.0, dist_white / 150) AS bs,
      0.18 * (1 - least(1.0, dist_black / 180)) + 0.18 * least(1.0, dist_white / 180) + 0.22 * least(1.0, dist_bg / 180) + 0.24 * least(1.0, area_ratio / 0.12::DOUBLE) + 0.18 * least(1.0, fill_ratio) AS fs,
      0.36 * (1 - least(1.0, dist_black / 180)) + 0.26 * (1 - least(1.0, fill_ratio)) + 0.2 * (1 - least(1.0, area_ratio / 0.12::DOUBLE)) + 0.1 * least(1.0, comp_count / 25) + 0.08 * border_ratio AS os FROM stats),
    s1 AS (SELECT *, {first_max('ps', 'true')} AS pad FROM s0),
    s2 AS (SELECT *, coalesce({first_max('bs', 'cluster <> pad')}, pad) AS bgc FROM s1),
    s3 AS (SELECT *, CASE WHEN bg_white < 18 THEN pad ELSE bgc END AS bk FROM s2),
    s4 AS (SELECT *, bool_or(cluster <> pad AND cluster <> bk) OVER (PARTITION BY image_id) AS a1, bool_or(cluster <> bk) OVER (PARTITION BY image_id) AS a2, min(cluster) OVER (PARTITION BY image_id) AS lo FROM s3),
    s5 AS (SELECT *, (CASE WHEN a1 THEN cluster <> pad AND cluster <> bk WHEN a2 THEN cluster <> bk ELSE cluster = lo END) AND (area_ratio >= 0.01 OR fs >= 0.45) AS fc FROM s4),
    s6 AS (SELECT *, {first_max('fs', 'fc')} AS bf, max(fs) FILTER (fc) OVER (PARTITION BY image_id) AS bfs, {first_max('area_ratio', 'cluster <> bk')} AS big FROM s5),
    s7 AS (SELECT *, coalesce(fc AND fs >= bfs * 0.62 AND area_ratio >= 0.004, false) AS st FROM s6),
    s8 AS (SELECT *, bool_or(st) OVER (PARTITION BY image_id) AS ast FROM s7),
    s9 AS (SELECT *, coalesce(CASE WHEN bf IS NULL THEN cluster = big WHEN ast THEN st ELSE cluster = bf END, false) AS fig FROM s8),
    t1 AS (SELECT *, bool_or(NOT fig AND cluster <> bk) OVER (PARTITION BY image_id) AS ao FROM s9),
    t2 AS (SELECT *, CASE WHEN ao THEN NOT fig AND cluster <> bk ELSE cluster <> bk END AS oc FROM t1),
    t3 AS (SELECT *, {first_max('os', 'oc')} AS ln, {first_max('os', 'oc AND dist_white >= 18')} AS dk, count(*) FILTER (oc) OVER (PARTITION BY image_id) AS noc FROM t2),
    t4 AS (SELECT *, coalesce(bool_or(cluster = ln AND dist_white < 18) OVER (PARTITION BY image_id), false) AND noc > 1 AS sw FROM t3),
    t5 AS (SELECT *, CASE WHEN sw THEN coalesce(dk, ln) ELSE ln END AS outl FROM t4),
    t6 AS (SELECT *, fig AND coalesce(cluster <> outl, true) AND cluster <> bk AS f2 FROM t5),
    t7 AS (SELECT *, bool_or(f2) OVER (PARTITION BY image_id) AS af2, {first_max('area_ratio', 'coalesce(cluster <> outl, true) AND cluster <> bk')} AS sp FROM t6)
    SELECT image_id, cluster, cluster = pad AS is_padding, cluster = bk AS is_background, CASE WHEN af2 THEN f2 ELSE cluster = coalesce(sp, outl) END AS is_figure, coalesce(cluster = outl, false) AS is_outline
    FROM t7""")
def _(t):
    return colors.cluster_roles(clustered(t))


def bright(t):
    return t.pixels().filter((F.col("r") + F.col("g")) > 250)


REGIONS = """fg AS (SELECT image_id, px, py FROM pixels WHERE r + g > 250),
    walk AS (SELECT image_id, px, py, px AS rx, py AS ry FROM fg UNION SELECT f.image_id, f.px, f.py, w.rx, w.ry FROM walk w JOIN fg f ON f.image_id = w.image_id AND abs(f.px - w.px) <= 1 AND abs(f.py - w.py) <= 1),
    regions AS (SELECT image_id, px, py, min((rx, ry)) AS region FROM walk GROUP BY image_id, px, py)"""


@register("connected_regions", f"WITH RECURSIVE {REGIONS} SELECT image_id, px, py, region[1] AS region_x, region[2] AS region_y FROM regions")
def _(t):
    return colors.connected_regions(bright(t)).select(
        "image_id", "px", "py", F.col("region.x").alias("region_x"), F.col("region.y").alias("region_y")
    )


@register("filter_small_regions", f"""WITH RECURSIVE {REGIONS}, areas AS (SELECT image_id, region, count(*) AS area FROM regions GROUP BY image_id, region),
    big AS (SELECT image_id, arg_max(region, (area, -region[2], -region[1])) AS region FROM areas GROUP BY image_id),
    core AS (SELECT r.image_id, px, py FROM regions r JOIN big b ON r.image_id = b.image_id AND r.region = b.region),
    near AS (SELECT DISTINCT r.image_id, r.region FROM regions r JOIN core c ON r.image_id = c.image_id AND abs(r.px - c.px) <= 1 AND abs(r.py - c.py) <= 1)
    SELECT r.image_id, r.px, r.py, a.area FROM regions r JOIN areas a ON r.image_id = a.image_id AND r.region = a.region LEFT JOIN near n ON n.image_id = r.image_id AND n.region = r.region
    WHERE n.region IS NOT NULL OR a.area >= 3""")
def _(t):
    sizes = t.pixels().groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    return colors.filter_small_regions(bright(t), sizes, 0.15, 2, 1).select("image_id", "px", "py", "area")


@register("figure_share_filter", f"WITH RECURSIVE {CLUSTERED} SELECT image_id, cluster, round(area_ratio, 6) AS area_ratio FROM stats WHERE area_ratio >= 0.1")
def _(t):
    rows = t.pixels().select("*", F.floor((F.col("r") + F.col("g") + F.col("b")) / 100).cast("long").alias("cluster"))
    sizes = t.pixels().groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    return colors.figure_share_filter(rows, sizes, 0.1).select("image_id", "cluster", rounded(F.col("area_ratio")).alias("area_ratio"))
