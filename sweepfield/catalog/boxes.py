"""Queries over detection boxes."""

from pyspark.sql import functions as F

from sweepfield.catalog.contours import r
from sweepfield.catalog.registry import register
from sweepfield.operators import boxes

IOU = """ix AS (SELECT a.image_id, a.box_id AS box_a, b.box_id AS box_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
      (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id
      AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""


@register("iou_pairs", f"WITH {IOU} SELECT image_id, box_a, box_b, round(i / (sa + sb - i), 6) AS iou, round(i / sb, 6) AS iog FROM ix")
def _(t):
    return boxes.iou_pairs(t.boxes()).select("image_id", "box_a", "box_b", *r("iou", "iog"))


def quads(t):
    """The boxes as quads with their corners in mixed order."""
    c = F.col
    b = t.boxes()
    shuffled = F.array(
        F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x0").alias("x"), c("y0").alias("y")),
        F.struct(c("x0").alias("x"), c("y1").alias("y")), F.struct(c("x1").alias("x"), c("y0").alias("y")),
    )
    return b.select("image_id", "box_id", "score", shuffled.alias("c")).select(
        "image_id", "box_id", "score", *[c("c")[i - 1][axis].alias(f"{axis}{i}") for i in range(1, 5) for axis in ("x", "y")]
    )


@register("quad_iou_pairs", f"WITH {IOU} SELECT image_id, box_a, box_b, round(i / (sa + sb - i), 6) AS iou FROM ix")
def _(t):
    return boxes.quad_iou_pairs(boxes.order_quad(quads(t))).select("image_id", "box_a", "box_b", *r("iou"))


# A limit that no overlap of whole-numbered boxes meets exactly.
LIMIT = 0.3003
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rk FROM {boxes}),
    hits AS (SELECT a.image_id, a.box_id, b.box_id AS other FROM {boxes} a JOIN {boxes} b ON a.image_id = b.image_id AND a.box_id <> b.box_id
      AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
      WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (1 + 0.3003)
        > 0.3003 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0))),
    foes AS (SELECT r.*, coalesce((SELECT list(other) FROM hits h WHERE h.image_id = r.image_id AND h.box_id = r.box_id), []) AS foes FROM ranked r),
    pick AS (SELECT image_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM ranked WHERE rk = 1
      UNION ALL SELECT p.image_id, f.rk, CASE WHEN list_has_any(p.kept, f.foes) THEN p.kept ELSE list_append(p.kept, f.box_id) END
      FROM pick p JOIN foes f ON f.image_id = p.image_id AND f.rk = p.rk + 1),
    stays AS (SELECT image_id, unnest(kept) AS box_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rk DESC) AS k FROM pick) WHERE k = 1)"""


def turned(df):
    """The boxes as quads turned by 45 degrees: overlaps stay in proportion."""
    x = {1: "x0", 2: "x1", 3: "x1", 4: "x0"}
    y = {1: "y0", 2: "y0", 3: "y1", 4: "y1"}
    corners = {f"x{i}": F.col(x[i]) - F.col(y[i]) for i in x} | {f"y{i}": F.col(x[i]) + F.col(y[i]) for i in x}
    return df.select("image_id", "box_id", "score", *[c.alias(n) for n, c in corners.items()])


@register("nms", f"WITH RECURSIVE {RANKED.format(boxes='boxes')} SELECT image_id, box_id, round(score, 6) AS score FROM boxes JOIN stays USING (image_id, box_id)")
def _(t):
    return boxes.nms(t.boxes(), LIMIT).select("image_id", "box_id", *r("score"))


@register("nms_quads", f"WITH RECURSIVE {RANKED.format(boxes='boxes')} SELECT image_id, box_id, round(score, 6) AS score FROM boxes JOIN stays USING (image_id, box_id)")
def _(t):
    return boxes.nms(turned(t.boxes()), LIMIT).select("image_id", "box_id", *r("score"))


SOFT = f"""WITH RECURSIVE {IOU}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS i, count(*) OVER (PARTITION BY image_id) AS n FROM boxes),
    w AS (SELECT image_id, box_a AS p, box_b AS q, exp(-pow(i / (sa + sb - i), 2) / 0.5) AS w FROM ix UNION ALL SELECT image_id, box_b, box_a, exp(-pow(i / (sa + sb - i), 2) / 0.5) FROM ix),
    near AS (SELECT o.image_id, o.i, list({{'i': q.i, 'w': w.w}} ORDER BY q.i) AS near FROM o JOIN w ON w.image_id = o.image_id AND w.p = o.box_id
      JOIN o q ON q.image_id = o.image_id AND q.box_id = w.q GROUP BY o.image_id, o.i),
    walk AS (SELECT image_id, list(score ORDER BY i) AS s, NULL::BIGINT AS i, NULL::DOUBLE AS score FROM o GROUP BY image_id
      UNION ALL SELECT image_id, list_transform(s, lambda v, j: CASE WHEN j = b THEN NULL WHEN list_contains(list_transform(near, lambda e: e.i), j)
          THEN (CASE WHEN v * near[list_position(list_transform(near, lambda e: e.i), j)].w >= 0.05 THEN v * near[list_position(list_transform(near, lambda e: e.i), j)].w END) ELSE v END), b, s[b]
        FROM (SELECT x.*, coalesce(near.near, []) AS near FROM (SELECT walk.image_id, walk.s, list_position(walk.s, list_max(walk.s))::BIGINT AS b FROM walk WHERE list_max(walk.s) IS NOT NULL) AS x
          LEFT JOIN near ON near.image_id = x.image_id AND near.i = x.b) AS y)
    SELECT walk.image_id, o.box_id, round(walk.score, 6) AS score FROM walk JOIN o USING (image_id, i)"""


@register("soft_nms", SOFT)
def _(t):
    return boxes.soft_nms(t.boxes(), floor=0.05).select("image_id", "box_id", *r("score"))


@register("soft_nms_quads", SOFT)
def _(t):
    return boxes.soft_nms(turned(t.boxes()), floor=0.05).select("image_id", "box_id", *r("score"))


MERGED = f"""WITH RECURSIVE o AS (SELECT image_id, box_id, x0, y0, x1, y1, score + 0.001 AS score, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS i FROM boxes),
    walk AS (SELECT image_id, i, box_id, x0, y0, x1, y1, score, box_id AS lead FROM o WHERE i = 1
      UNION ALL SELECT image_id, i, box_id, CASE WHEN hit THEN (score * x0 + ps * px0) / (score + ps) ELSE x0 END, CASE WHEN hit THEN (score * y0 + ps * py0) / (score + ps) ELSE y0 END,
        CASE WHEN hit THEN (score * x1 + ps * px1) / (score + ps) ELSE x1 END, CASE WHEN hit THEN (score * y1 + ps * py1) / (score + ps) ELSE y1 END,
        CASE WHEN hit THEN score + ps ELSE score END, CASE WHEN hit THEN lead ELSE box_id END
      FROM (SELECT *, shared / ((x1 - x0) * (y1 - y0) + (px1 - px0) * (py1 - py0) - shared) > 0.3003 AS hit FROM (
        SELECT o.*, w.x0 AS px0, w.y0 AS py0, w.x1 AS px1, w.y1 AS py1, w.score AS ps, w.lead,
          greatest(0, least(o.x1, w.x1) - greatest(o.x0, w.x0)) * greatest(0, least(o.y1, w.y1) - greatest(o.y0, w.y0)) AS shared
        FROM walk w JOIN o ON o.image_id = w.image_id AND o.i = w.i + 1) AS x) AS y),
    merged AS (SELECT image_id, lead AS box_id, x0, y0, x1, y1, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, lead ORDER BY i DESC) AS k FROM walk) WHERE k = 1),
    {RANKED.format(boxes='merged')}
    SELECT image_id, box_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(score, 6) AS score FROM merged JOIN stays USING (image_id, box_id)"""


def weighted(t):
    # A score of zero has no weight to merge with.
    return t.boxes().withColumn("score", F.col("score") + 0.001)


@register("locality_merge", MERGED)
def _(t):
    return boxes.locality_merge(weighted(t), LIMIT).select("image_id", "box_id", *r("x0", "y0", "x1", "y1", "score"))


@register("locality_merge_quads", MERGED)
def _(t):
    # Turned back, the merged quads are the boxes again.
    c = F.col
    back = {"x0": c("x1") + c("y1"), "y0": c("y1") - c("x1"), "x1": c("x3") + c("y3"), "y1": c("y3") - c("x3")}
    made = boxes.locality_merge(turned(weighted(t)), LIMIT)
    return made.select("image_id", "box_id", "score", *[(v / 2).alias(n) for n, v in back.items()]).select("image_id", "box_id", *r("x0", "y0", "x1", "y1", "score"))


@register("drop_low_score", "SELECT image_id, box_id FROM boxes WHERE score >= 0.05")
def _(t):
    return boxes.drop_low_score(t.boxes(), 0.05).select("image_id", "box_id")


@register("reading_order", """WITH RECURSIVE s AS (SELECT image_id, box_id, x0 AS x, y0 AS y, row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, box_id) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM boxes),
    walk AS (SELECT image_id, 1::BIGINT AS k, box_id AS carry, x, y, n, NULL::BIGINT AS placed FROM s WHERE k = 1
      UNION ALL SELECT w.image_id, w.k + 1, CASE WHEN abs(s.y - w.y) < 10 AND s.x < w.x THEN w.carry ELSE s.box_id END, CASE WHEN abs(s.y - w.y) < 10 AND s.x < w.x THEN w.x ELSE s.x END,
        CASE WHEN abs(s.y - w.y) < 10 AND s.x < w.x THEN w.y ELSE s.y END, w.n, CASE WHEN abs(s.y - w.y) < 10 AND s.x < w.x THEN s.box_id ELSE w.carry END FROM walk w JOIN s ON s.image_id = w.image_id AND s.k = w.k + 1)
    SELECT image_id, placed AS box_id, k - 1 AS place FROM walk WHERE k > 1 UNION ALL SELECT image_id, carry, k FROM walk WHERE k = n""")
def _(t):
    rows = t.boxes().select("image_id", "box_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return boxes.reading_order(rows)


@register("order_quad", "SELECT image_id, box_id, x0 AS tlx, y0 AS tly, x1 AS trx, y0 AS \"try\", x1 AS brx, y1 AS bry, x0 AS blx, y1 AS bly FROM boxes")
def _(t):
    names = dict(zip(boxes.QUAD, ["tlx", "tly", "trx", "try", "brx", "bry", "blx", "bly"]))
    return boxes.order_quad(quads(t)).select("image_id", "box_id", *[F.col(c).alias(n) for c, n in names.items()])


@register("clip_and_filter_boxes", """WITH c AS (SELECT image_id, box_id, floor(least(x0 + 0.5, 59.0)) AS ax, floor(least(y0, 49.0)) AS ay, floor(least(x1 + 0.5, 59.0)) AS bx, floor(least(y1, 49.0)) AS b_y FROM boxes)
    SELECT image_id, box_id, ax AS x1, ay AS y1, bx AS x3, b_y AS y3 FROM c WHERE bx - ax > 3 AND b_y - ay > 3""")
def _(t):
    shifted = quads(t).withColumns({f"x{i}": F.col(f"x{i}") + 0.5 for i in range(1, 5)})
    return boxes.clip_and_filter_boxes(shifted, 60, 50).select("image_id", "box_id", "x1", "y1", "x3", "y3")
