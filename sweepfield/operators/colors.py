"""Colour and material labels of ``pixels(image_id, px, py, r, g, b)``."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.plans.components import grid_components
from sweepfield.plans.sizing import broadcast_if_small

IMAGE = ["image_id"]
# Closed HSV boxes of each colour name, hue 0..180.
COLOR_RANGES = [
    ("black", (0, 0, 0), (180, 255, 30)),
    ("gray", (0, 0, 46), (180, 43, 220)),
    ("white", (0, 0, 221), (180, 30, 255)),
    ("red", (0, 43, 46), (10, 255, 255)),
    ("red", (156, 43, 46), (180, 255, 255)),
    ("orange", (11, 43, 46), (25, 255, 255)),
    ("yellow", (26, 43, 46), (34, 255, 255)),
    ("green", (35, 43, 46), (77, 255, 255)),
    ("cyan", (78, 43, 46), (99, 255, 255)),
    ("blue", (100, 43, 46), (124, 255, 255)),
    ("purple", (125, 43, 46), (155, 255, 255)),
]
FIXED_POINT = 4096  # fixed value: HSV divisions are rounded in twelve-bit fixed point


def rgb_to_hsv(pixels: DataFrame) -> DataFrame:
    """Add integer ``h`` (0..180), ``s`` and ``v`` (0..255)."""
    r, g, b = (F.col(c).cast("long") for c in ("r", "g", "b"))
    v = F.greatest(r, g, b)
    spread = v - F.least(r, g, b)
    scaled = lambda top, unit, by: F.when(
        by > 0, F.floor((top * F.rint(F.try_divide(F.lit(unit * FIXED_POINT), by)) + FIXED_POINT // 2) / FIXED_POINT)
    ).otherwise(0).cast("long")
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)
    hue = scaled(turn, 180, 6 * spread)
    out = pixels.select("*", hue.alias("_h"), scaled(spread, 255, v).alias("s"), v.alias("v"))
    return out.select(*pixels.columns, F.when(F.col("_h") < 0, F.col("_h") + 180).otherwise(F.col("_h")).alias("h"), "s", "v")


def _names(ranges) -> list[str]:
    return list(dict.fromkeys(name for name, _, _ in ranges))


def _hits(ranges) -> dict[str, Column]:
    """Condition per colour name; several boxes of a name are alternatives."""
    hits: dict[str, Column] = {}
    for name, low, high in ranges:
        box = F.col("h").between(low[0], high[0]) & F.col("s").between(low[1], high[1]) & F.col("v").between(low[2], high[2])
        hits[name] = hits[name] | box if name in hits else box
    return hits


def label_colors(pixels: DataFrame, ranges=None) -> DataFrame:
    """One row per pixel and matching colour name; a pixel may match several or none.

    The ranges are a small fixed list, so they are conditions, not a join.
    """
    names = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in _hits(ranges or COLOR_RANGES).items()]))
    return rgb_to_hsv(pixels).select(*IMAGE, "px", "py", F.explode(names).alias("color"))


def color_shares(pixels: DataFrame, ranges=None) -> DataFrame:
    """Area and percentage of each colour name per image, zeros kept: one aggregate."""
    ranges = ranges or COLOR_RANGES
    counts = rgb_to_hsv(pixels).groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(hit).alias(f"_{name}") for name, hit in _hits(ranges).items()]
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(name).alias("color"), F.col(f"_{name}").alias("area")) for i, name in enumerate(_names(ranges))
    ])
    return counts.select(*IMAGE, "_all", F.inline(rows)).select(
        *IMAGE, "rank", "color", "area", (F.col("area") / F.col("_all") * 100).alias("percentage")
    )


def dominant_colors(shares: DataFrame, n: int = 3, threshold: float = 1.0) -> DataFrame:
    """The ``n`` largest colours of at least ``threshold`` percent, in range order on ties."""
    order = Window.partitionBy(*IMAGE).orderBy(F.desc("percentage"), "rank")
    kept = shares.filter(F.col("percentage") >= threshold).withColumn("place", F.row_number().over(order))
    return kept.filter(F.col("place") <= n).select(*IMAGE, "place", "color", "percentage")


def solid_material(pixels: DataFrame, materials: DataFrame, ranges=None) -> DataFrame:
    """Main colour of each region and its material; ``keep`` marks conductors.

    The first non-black of the two largest colours; ``materials(color, material)``.
    """
    top = dominant_colors(color_shares(pixels, ranges), 2).filter(F.col("color") != "black")
    first = top.groupBy(*IMAGE).agg(F.min_by("color", "place").alias("color"))
    return first.join(broadcast_if_small(materials), "color", "left").select(
        *IMAGE, "color", "material", F.coalesce(F.col("material") == "PEC", F.lit(False)).alias("keep")
    )


def vote_clusters(costs, silhouettes, ratios, max_k: int, vote: str = "least") -> int:
    """Number of clusters from three indicators, each listed from one cluster on.

    The bend of the cost curve, the silhouette and the variance ratio name one
    number each. As it stands the rule takes the number named least often, the
    smallest of several; ``vote="most"`` takes the one named most often.
    """
    drops = np.diff(np.asarray(costs, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        bends = np.nan_to_num(np.abs(drops[1:] / drops[:-1]), nan=np.inf, posinf=np.inf)
    named = [2 + int(np.argmin(bends)) if len(bends) else 2]
    named += [2 + int(np.argmax(scores[1:])) if len(scores) > 1 else 2 for scores in (silhouettes, ratios)]
    votes = Counter(k for k in named if k <= max_k)
    wanted = (min if vote == "least" else max)(votes.values(), default=0)
    return min((k for k, n in votes.items() if n == wanted), default=2)


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """CIE LAB under D65, on the scale of eight-bit images (lightness 0 to 255)."""
    linear = np.where(rgb > 10.31475, ((rgb / 255 + 0.055) / 1.055) ** 2.4, rgb / 255 / 12.92)
    # sRGB primaries and the white point.
    xyz = linear @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / [0.950456, 1.0, 1.088754]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def _far_seeds(colors: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The commonest colour, then always the colour farthest from those taken; the first of equals."""
    taken = [int(np.argmax(weights))]
    away = ((colors - colors[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < k:
        taken.append(int(np.argmax(away)))
        away = np.minimum(away, ((colors - colors[taken[-1]]) ** 2).sum(axis=1))
    return colors[taken].astype(float)


def weighted_clusters(colors: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd rounds over distinct colours: centres, label and squared distances of every colour to every centre."""
    centres = _far_seeds(colors, weights, k)
    label = None
    for _ in range(rounds):
        away = ((colors[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        new = away.argmin(axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        mass = np.bincount(label, weights, minlength=k)
        for c in range(3):
            sums = np.bincount(label, weights * colors[:, c], minlength=k)
            centres[:, c] = np.where(mass > 0, sums / np.maximum(mass, 1), centres[:, c])
    return centres, label, away


def _palette(colors: np.ndarray, weights: np.ndarray, white_border: float, max_k: int, min_difference: float, vote: str):
    """Cluster of every colour of one image, and the centres."""
    total, most = weights.sum(), min(max_k, len(colors))
    fits, costs, silhouettes, ratios = [], [], [], []
    for k in range(1, most + 1):
        centres, label, away = weighted_clusters(colors, weights, k)
        own = away[np.arange(len(colors)), label]
        other = np.where(np.arange(k) == label[:, None], np.inf, away).min(axis=1) if k > 1 else own
        a, b = np.sqrt(own), np.sqrt(other)
        fits.append((centres, label))
        costs.append(float(weights @ own))
        # Distances to centres stand for those to all members.
        silhouettes.append(float(weights @ ((b - a) / np.maximum(np.maximum(a, b), 1e-12)) / total) if k > 1 else 0.0)
        spread = (costs[0] - costs[-1]) / (k - 1) / (costs[-1] / (total - k)) if k > 1 and costs[-1] > 0 and total > k else 0.0
        ratios.append(float(spread))
    k = min(vote_clusters(costs, silhouettes, ratios, most, vote), most)
    centres, label = fits[k - 1]
    lab = lab_of(np.floor(centres))
    gaps = np.sqrt(((lab[:, None] - lab[None]) ** 2).sum(axis=2))[np.triu_indices(k, 1)]
    if k < most and (gaps < min_difference).any():
        k += 1  # two centres look alike
    # How near to white a centre is pure or merged, its share, and the border's share.
    to_white = np.sqrt(((centres - 255.0) ** 2).sum(axis=1))
    share = np.bincount(label, weights, minlength=len(centres)) / total
    hidden = ((to_white > 18) & (to_white <= 85) & (share >= 0.08)).any() and not (to_white <= 18).any()
    if k < most and white_border >= 0.06 and hidden:
        k += 1  # a white border has merged into a light shape
    return fits[k - 1]


def quantize_colors(pixels: DataFrame, max_k: int = 6, min_difference: float = 30.0, vote: str = "least") -> DataFrame:
    """Assign every pixel to a colour cluster of its own image: adds ``cluster`` and ``palette``.

    Each image's pixels are first counted by colour, so what a task holds of an
    image is its distinct colours, 2^24 at most whatever its size. All of them
    are clustered; the number of clusters follows from three indicators, more
    by one when two centres look alike, and by one when a white border (within
    24 of white, on a strip of 1/80 of the shorter side) hides in a light shape.
    """
    c = F.col
    extent = pixels.groupBy(*IMAGE).agg(*[f(n).alias(f"_{f.__name__}_{n}") for n in ("px", "py") for f in (F.min, F.max)])
    short = F.least(c("_max_px") - c("_min_px"), c("_max_py") - c("_min_py")) + 1
    strip = F.greatest(F.lit(2), F.floor(short / 80))
    placed = pixels.join(broadcast_if_small(extent), IMAGE)
    # Corner pixels belong to two sides and count twice.
    sides = reduce(lambda x, y: x + y, [
        F.when(near, 1).otherwise(0) for n in ("px", "py") for near in (c(n) < c(f"_min_{n}") + strip, c(n) > c(f"_max_{n}") - strip)])
    counts = placed.groupBy(*IMAGE, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(sides).alias("edge"))

    def cluster(image: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in "rgb"])
        colors = np.column_stack([table.column(n).to_numpy() for n in "rgb"]).astype(float)
        weights, edge = (table.column(n).to_numpy().astype(float) for n in ("n", "edge"))
        white = np.sqrt(((colors - 255.0) ** 2).sum(axis=1)) <= 24.0
        centres, label = _palette(colors, weights, float(edge[white].sum() / max(edge.sum(), 1.0)), max_k, min_difference, vote)
        palette = np.floor(centres).astype(int)
        return pa.table({
            "image_id": table.column("image_id"), **{n: table.column(n) for n in "rgb"}, "cluster": pa.array(label, pa.int32()),
            "palette": pa.array([palette[k].tolist() for k in label], pa.list_(pa.int32()))})

    fields = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = ", ".join(f"{n} {fields[n]}" for n in ("image_id", "r", "g", "b")) + ", cluster int, palette array<int>"
    named = counts.groupBy(*IMAGE).applyInArrow(cluster, schema)
    return pixels.join(named, [*IMAGE, "r", "g", "b"]).select(*pixels.columns, "cluster", "palette")


def cluster_stats(pixels: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Shape and colour figures of each cluster of an image, and its number of 8-connected pieces.

    ``pixels(image_id, px, py, cluster, r, g, b)`` with the cluster's colour;
    ``backgrounds(image_id, bg_r, bg_g, bg_b)`` gives the known background. The
    border strip is 1/80 of the shorter side, at least 2 pixels.
    """
    c = F.col
    extent = pixels.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("_total"), F.min("px").alias("_x0"), F.max("px").alias("_x1"), F.min("py").alias("_y0"), F.max("py").alias("_y1")
    )
    short = F.least(c("_x1") - c("_x0"), c("_y1") - c("_y0")) + 1
    extent = extent.withColumn("_strip", F.greatest(F.lit(2), F.floor(short / 80)))
    edge = (
        (c("px") < c("_x0") + c("_strip")) | (c("px") > c("_x1") - c("_strip"))
        | (c("py") < c("_y0") + c("_strip")) | (c("py") > c("_y1") - c("_strip"))
    )
    rows = pixels.join(broadcast_if_small(extent), IMAGE)
    part = rows.groupBy(*IMAGE, "cluster").agg(
        F.count(F.lit(1)).alias("area"), F.count_if(edge).alias("_hits"), *[F.avg(n).alias(n) for n in "rgb"],
        ((F.max("px") - F.min("px") + 1) * (F.max("py") - F.min("py") + 1)).alias("_box"),
    )
    whole = part.groupBy(*IMAGE).agg(F.sum("_hits").alias("_border"), F.sum("area").alias("_total"))
    pieces = connected_regions(pixels, [*IMAGE, "cluster"]).groupBy(*IMAGE, "cluster").agg(
        F.count_distinct("region").alias("comp_count"))
    joined = part.join(whole, IMAGE).join(broadcast_if_small(backgrounds), IMAGE).join(pieces, [*IMAGE, "cluster"])

    def away(a: list[Column], b: list[Column]) -> Column:
        return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))

    own, known = [c(n) for n in "rgb"], [c(f"bg_{n}") for n in "rgb"]
    level = lambda v: [F.lit(v)] * 3
    return joined.select(
        *IMAGE, "cluster", "area", (c("area") / c("_total")).alias("area_ratio"),
        (c("_hits") / F.greatest(F.lit(1), c("_border"))).alias("border_ratio"), (c("area") / F.greatest(F.lit(1), c("_box"))).alias("fill_ratio"),
        away(own, level(0.0)).alias("dist_black"), away(own, level(255.0)).alias("dist_white"), away(own, known).alias("dist_bg"),
        away(known, level(255.0)).alias("bg_white"), "comp_count",
    )


def cluster_roles(stats: DataFrame, min_figure: float = 0.01, white_limit: float = 18.0) -> DataFrame:
    """Padding, background, figure or outline role of each cluster.

    ``stats`` comes from ``cluster_stats``. An image has a handful of clusters,
    judged in one window; the only cluster of an image is its figure and background.
    """
    c = F.col
    part = lambda value, limit: F.least(F.lit(1.0), value / limit)
    black, white, bg = c("dist_black"), c("dist_white"), c("dist_bg")
    # The weights and limits of the four scores.
    scored = stats.select(
        "*",
        (0.62 * (1.0 - part(white, 160.0)) + 0.26 * c("border_ratio") + 0.12 * (1.0 - part(c("area_ratio"), 0.9))).alias("padding_score"),
        (0.54 * (1.0 - part(bg, 180.0)) + 0.16 * c("border_ratio") + 0.16 * part(black, 150.0) + 0.14 * part(white, 150.0)).alias("bg_score"),
        (
            0.18 * (1.0 - part(black, 180.0)) + 0.18 * part(white, 180.0) + 0.22 * part(bg, 180.0)
            + 0.24 * part(c("area_ratio"), 0.12) + 0.18 * F.least(F.lit(1.0), c("fill_ratio"))
        ).alias("fig_score"),
        (
            0.36 * (1.0 - part(black, 180.0)) + 0.26 * (1.0 - F.least(F.lit(1.0), c("fill_ratio"))) + 0.20 * (1.0 - part(c("area_ratio"), 0.12))
            + 0.10 * part(c("comp_count"), 25.0) + 0.08 * c("border_ratio")
        ).alias("outline_score"),
    )
    image = Window.partitionBy(*IMAGE)
    # First of equals: the smallest cluster number wins.
    best = lambda score, among: F.max(F.when(among, F.struct(score.alias("s"), (-c("cluster")).alias("k")))).over(image)
    chosen = lambda score, among: -best(score, among)["k"]
    is_ = lambda name: c("cluster") == c(name)
    any_of = lambda flag: F.coalesce(F.bool_or(flag).over(image), F.lit(False))
    rows = scored.withColumn("padding", chosen(c("padding_score"), F.lit(True)))
    others = any_of(c("cluster") != c("padding"))
    rows = rows.withColumn("_others", others).withColumn(
        "background", F.when(c("bg_white") < 18.0, c("padding")).otherwise(
            chosen(c("bg_score"), ~c("_others") | ~is_("padding"))
        )
    )
    rows = rows.withColumn("_pool1", ~is_("padding") & ~is_("background")).withColumn("_any1", any_of(c("_pool1")))
    rows = rows.withColumn("_pool2", ~is_("background")).withColumn("_any2", any_of(c("_pool2")))
    first = F.min("cluster").over(image)
    rows = rows.withColumn("_first", first).withColumn(
        "_pool", F.when(c("_any1"), c("_pool1")).when(c("_any2"), c("_pool2")).otherwise(is_("_first"))
    )
    rows = rows.withColumn("_figure", c("_pool") & ((c("area_ratio") >= min_figure) | (c("fig_score") >= 0.45)))
    rows = rows.withColumn("_anyfig", any_of(c("_figure"))).withColumn("_bestfig", best(c("fig_score"), c("_figure")))
    rows = rows.withColumn("_largest", chosen(c("area_ratio"), c("_pool2")))
    strong = c("_figure") & (c("fig_score") >= c("_bestfig.s") * 0.62) & (c("area_ratio") >= 0.004)
    rows = rows.withColumn("_strong", F.coalesce(strong, F.lit(False))).withColumn("_anystrong", any_of(c("_strong")))
    figure = F.when(~c("_anyfig"), is_("_largest")).when(c("_anystrong"), c("_strong")).otherwise(c("cluster") == -c("_bestfig.k"))
    rows = rows.withColumn("figure", F.coalesce(figure, F.lit(False)))
    rows = rows.withColumn("_out1", ~c("figure") & ~is_("background")).withColumn("_anyout1", any_of(c("_out1")))
    rows = rows.withColumn("_out", F.when(c("_anyout1"), c("_out1")).otherwise(c("_pool2")))
    rows = rows.withColumn("_line", chosen(c("outline_score"), c("_out"))).withColumn("_outs", F.count_if("_out").over(image))
    near_white = any_of(is_("_line") & (c("dist_white") < white_limit)) & (c("_outs") > 1)
    dark = c("_out") & (c("dist_white") >= white_limit)
    rows = rows.withColumn("_swap", near_white).withColumn("_dark", chosen(c("outline_score"), dark))
    rows = rows.withColumn("outline", F.when(c("_swap"), F.coalesce("_dark", "_line")).otherwise(c("_line")))
    rows = rows.withColumn("_fig2", c("figure") & ~is_("outline") & ~is_("background")).withColumn("_anyfig2", any_of(c("_fig2")))
    rows = rows.withColumn("_spare", chosen(c("area_ratio"), ~is_("outline") & ~is_("background")))
    final = F.when(c("_anyfig2"), c("_fig2")).otherwise(c("cluster") == F.coalesce("_spare", "outline"))
    return rows.select(
        *IMAGE, "cluster", is_("padding").alias("is_padding"), is_("background").alias("is_background"),
        final.alias("is_figure"), F.coalesce(is_("outline"), F.lit(False)).alias("is_outline"),
    )


def connected_regions(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Label 8-connected foreground pixels: ``pixels(image_id, px, py, …)``; label is the region's least pixel."""
    return grid_components(pixels, keys or IMAGE, "px", "py")


def region_areas(regions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return regions.groupBy(*(keys or IMAGE), "region").agg(F.count(F.lit(1)).alias("area"))


def filter_small_regions(
    pixels: DataFrame, sizes: DataFrame, min_ratio: float = 0.0015, min_pixels: int = 12, reach: int = 8
) -> DataFrame:
    """Foreground pixels without small regions, except those near the largest one.

    ``sizes(image_id, total)`` is the pixel count of each image. A region stays
    when it is large enough or comes within ``reach`` pixels, diagonally
    counted, of the largest region.
    """
    regions = connected_regions(pixels)
    areas = region_areas(regions)
    # The first label wins among equal areas.
    largest = areas.groupBy(*IMAGE).agg(
        F.max_by("region", F.struct("area", (-F.col("region.y")).alias("y"), (-F.col("region.x")).alias("x"))).alias("region")
    )
    top = regions.join(largest, [*IMAGE, "region"], "left_semi").select(*IMAGE, "px", "py")
    span = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    # Grow along one axis, then the other, dropping repeats in between.
    wide = top.select(*IMAGE, "py", "px", span.alias("d")).select(*IMAGE, (F.col("px") + F.col("d")).alias("px"), "py").distinct()
    grown = wide.select(*IMAGE, "px", "py", span.alias("d")).select(*IMAGE, "px", (F.col("py") + F.col("d")).alias("py")).distinct()
    near = regions.join(grown, [*IMAGE, "px", "py"], "left_semi").select(*IMAGE, "region").distinct().withColumn("_near", F.lit(True))
    limit = F.greatest(F.lit(min_pixels), F.floor(F.col("total") * min_ratio))
    kept = areas.join(broadcast_if_small(sizes), IMAGE).join(near, [*IMAGE, "region"], "left").filter(
        F.coalesce("_near", F.lit(False)) | (F.col("area") >= limit)
    )
    return regions.join(kept.select(*IMAGE, "region", "area"), [*IMAGE, "region"]).select(*IMAGE, "px", "py", "region", "area")


def figure_share_filter(pixels: DataFrame, sizes: DataFrame, threshold: float = 0.033) -> DataFrame:
    """Clusters that cover at least ``threshold`` of their image."""
    part = pixels.groupBy(*IMAGE, "cluster").agg(F.count(F.lit(1)).alias("area"))
    return part.join(broadcast_if_small(sizes), IMAGE).select(
        *IMAGE, "cluster", (F.col("area") / F.col("total")).alias("area_ratio")
    ).filter(F.col("area_ratio") >= threshold)


