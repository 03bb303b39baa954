"""Operators against plain loops on small random inputs, above the small-group shortcuts."""

import math
import random

import numpy as np
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from sweepfield.operators import boxes, colors, contours, fits, primitives, repair, segments
from sweepfield.plans import blocks as plan_blocks
from sweepfield.plans import components
from sweepfield.plans.ordered import NO_SPLIT


@pytest.fixture(scope="module")
def outline():
    rng = random.Random(1)
    x = y = 0.0
    rows = []
    for i in range(260):
        x, y = x + rng.uniform(-1, 1.2), y + rng.uniform(-1, 1)
        rows.append((i, round(x, 3), round(y, 3)))
    rows.append((260, rows[40][1], rows[40][2]))  # touches a former vertex
    return rows


def table(spark, outline, key="contour_id"):
    return spark.createDataFrame([(1, i, x, y) for i, x, y in outline], f"{key} long, idx long, x double, y double")


def crosses(a, b, c, d, tol, limit, touching):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    on = lambda p, q, r: all(min(p[k], r[k]) - tol <= q[k] <= max(p[k], r[k]) + tol for k in (0, 1))
    o = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if o[0] * o[1] < limit and o[2] * o[3] < limit:
        return True
    ends = ((a, c, b), (a, d, b), (c, a, d), (c, b, d))
    return touching and any(abs(t) <= tol and on(*e) for t, e in zip(o, ends))


@pytest.mark.parametrize("variant, tol, limit, touching", [("touch", 1e-9, 0.0, True), ("proper", 0.0, 0.0, False), ("loop", 1e-7, -1e-7, True)])
def test_crossings(spark, outline, variant, tol, limit, touching):
    points = [(x, y) for _, x, y in outline]
    edges = list(zip(points, points[1:] + points[:1]))
    want = {
        (i, j) for i in range(len(edges)) for j in range(i + 2, len(edges))
        if not (i == 0 and j == len(edges) - 1) and crosses(*edges[i], *edges[j], tol, limit, touching)
    }
    rows = contours.crossing_pairs(table(spark, outline), variant, NO_SPLIT).collect()
    assert len(rows) == len(want) and {(r.edge_a, r.edge_b) for r in rows} == want


def test_minimum_gap_with_components(spark, outline):
    rows = [(1, i % 3, i // 3, x, y) for i, x, y in outline]
    last = {c: max(i for _, k, i, _, _ in rows if k == c) for c in range(3)}
    best = min(
        math.hypot(a[3] - b[3], a[4] - b[4]) for n, a in enumerate(rows) for b in rows[n + 1 :]
        if not (a[1] == b[1] and (abs(a[2] - b[2]) <= 1 or {a[2], b[2]} == {0, last[a[1]]}))
    )
    df = spark.createDataFrame(rows, "contour_id long, comp long, idx long, x double, y double")
    assert contours.minimum_gap(df, NO_SPLIT).first().minimum_gap == pytest.approx(best)


def test_nearest_distances_use_the_pyramid(spark, outline):
    a = np.array([(x, y) for _, x, y in outline])
    b = np.roll(a, 90, axis=0) + [0.3, -0.1]
    make = lambda p: spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pair_id long, idx long, x double, y double")
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    got = {r.idx: r.distance for r in fits.nearest_distances(make(a), make(b)).collect()}
    assert len(got) == len(a) and all(got[i] == pytest.approx(want[i]) for i in range(len(a)))


def test_junctions(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.uniform(0, 30), rng.uniform(0, 30)) for d in (1, 2) for i in range(150)]
    want = set()
    for design in (1, 2):
        clusters = []
        for _, i, x, y in (r for r in rows if r[0] == design):
            for c in clusters:
                if math.hypot(x - sum(p[1] for p in c) / len(c), y - sum(p[2] for p in c) / len(c)) <= 1.0:
                    c.append((i, x, y))
                    break
            else:
                clusters.append([(i, x, y)])
        want |= {(design, c[0][0], p[0]) for c in clusters if len(c) > 1 for p in c}
    df = spark.createDataFrame(rows, "design_id long, seq long, x double, y double")
    for limit in (2000, 50):
        assert {(r.design_id, r.junction, r.seq) for r in primitives.junctions(df, fold_limit=limit).collect()} == want


def box_rows(n, spread=60):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x, y = rng.uniform(0, spread), rng.uniform(0, spread)
        rows.append((1, i, x, y, x + rng.uniform(4, 12), y + rng.uniform(4, 12), rng.random()))
    return rows


def box_table(spark, rows):
    return spark.createDataFrame(rows, "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double")


def iou(a, b):
    w = min(a[4], b[4]) - max(a[2], b[2])
    h = min(a[5], b[5]) - max(a[3], b[3])
    shared = max(w, 0) * max(h, 0)
    return shared / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - shared)


def quad_table(spark, rows, angle):
    """The boxes turned by an angle, as quads."""
    turn = lambda x, y: (x * math.cos(angle) - y * math.sin(angle), x * math.sin(angle) + y * math.cos(angle))
    made = [(r[0], r[1], *[c for p in ((r[2], r[3]), (r[4], r[3]), (r[4], r[5]), (r[2], r[5])) for c in turn(*p)], r[6]) for r in rows]
    return spark.createDataFrame(made, "image_id long, box_id long, " + ", ".join(f"{c} double" for c in boxes.QUAD) + ", score double")


def soft_walk(rows, weight, floor):
    left, final = [list(r) for r in rows], set()
    while left:
        best = max(left, key=lambda r: (r[6], -r[1]))
        left.remove(best)
        final.add((best[1], round(best[6], 9)))
        for r in list(left):
            if iou(best, r) > 0:
                r[6] *= weight(iou(best, r))
                if r[6] < floor:
                    left.remove(r)
    return final


@pytest.mark.parametrize("angle", [None, 0.5])
def test_suppression(spark, angle):
    rows = box_rows(30, 40) + [(1, 900 + i, 3.0, 3.0, 9.0, 9.0, 0.5) for i in range(4)]  # equal boxes and scores
    kept, left = set(), sorted(rows, key=lambda r: (-r[6], r[1]))
    while left:
        best = left.pop(0)
        kept.add(best[1])
        left = [r for r in left if iou(best, r) <= 0.3]
    df = box_table(spark, rows) if angle is None else quad_table(spark, rows, angle)
    assert {r.box_id for r in boxes.nms(df, 0.3).collect()} == kept
    soft = lambda **k: {(r.box_id, round(r.score, 9)) for r in boxes.soft_nms(df, floor=0.2, **k).collect()}
    if angle is None:
        assert soft(method="gaussian") == soft_walk(rows, lambda v: math.exp(-v * v / 0.5), 0.2)
    else:
        assert soft(method="linear") == soft_walk(rows, lambda v: 1 - v if v > 0.3 else 1, 0.2)
    assert boxes.nms(df.limit(0), 0.3).count() == 0 and boxes.soft_nms(df.limit(0)).count() == 0


def test_a_large_box_meets_small_ones_once(spark):
    rows = [(1, i, float(i % 40) * 10, float(i // 40) * 10, i % 40 * 10 + 4.0, i // 40 * 10 + 4.0, 0.5) for i in range(1600)]
    df = box_table(spark, rows + [(1, 9000, 0.0, 0.0, 400.0, 400.0, 0.9), (1, 9001, 7.0, 7.0, 7.0, 7.0, 0.9)])
    pairs = boxes.iou_pairs(df).cache()
    assert pairs.count() == 1600 and pairs.filter("box_b = 9000").count() == 1600
    # What the grid brings together, before any test of the overlap itself.
    met = boxes._cells(df.withColumn("own", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9)))).cast("int")), F.col("own"))
    assert met.count() <= 4 * df.count()


def test_suppression_repeats_nothing(spark):
    once = boxes.nms(box_table(spark, box_rows(80)), 0.3).cache()
    assert as_set(boxes.nms(once, 0.3)) == as_set(once)


@pytest.mark.parametrize("block,angle", [(20_000, None), (8, 0.5)])
def test_locality_merge(spark, block, angle, monkeypatch):
    monkeypatch.setattr(plan_blocks, "BLOCK", block)
    rows = sorted(box_rows(150, 40), key=lambda r: r[3])
    rows = [(1, i, *r[2:]) for i, r in enumerate(rows[:60])]
    # A chain that stays open over many blocks.
    rows += [(1, 500 + i, 100.0 + i / 10, 100.0, 110.0 + i / 10, 110.0, 0.5) for i in range(20)]
    merged, last = [], None
    for r in rows:
        if last is not None and iou(r, last) > 0.3:
            total = r[6] + last[6]
            last = (1, last[1], *[(r[6] * b + last[6] * a) / total for a, b in zip(last[2:6], r[2:6])], total)
        else:
            if last is not None:
                merged.append(last)
            last = r
    merged.append(last)
    kept, left = set(), sorted(merged, key=lambda r: (-r[6], r[1]))
    while left:
        best = left.pop(0)
        kept.add((best[1], round(best[6], 6)))
        left = [r for r in left if iou(best, r) <= 0.3]
    got = boxes.locality_merge(box_table(spark, rows) if angle is None else quad_table(spark, rows, angle), 0.3, NO_SPLIT)
    assert {(r.box_id, round(r.score, 6)) for r in got.collect()} == kept


def test_quad_overlap():
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s]]
    diamond = [[1, -0.5], [2.5, 1], [1, 2.5], [-0.5, 1]]
    cases = [
        (square(0, 0, 2), square(0, 0, 2), 4.0), (square(0, 0, 2), square(2, 0, 2), 0.0), (square(0, 0, 2), square(1, 1, 2), 1.0),
        (square(0, 0, 4), square(1, 1, 1), 1.0), (square(0, 0, 2), square(0, 1, 2), 2.0), (square(0, 0, 2), square(5, 5, 1), 0.0),
        (square(0, 0, 2), diamond, 4 - 4 * 0.125), (square(0, 0, 2), square(0, 0, 2)[::-1], 4.0),
    ]
    a, b = (np.array([c[k] for c in cases], dtype=float) for k in (0, 1))
    assert boxes._shared_area(a, b) == pytest.approx([c[2] for c in cases])
    assert boxes._shared_area(b, a) == pytest.approx([c[2] for c in cases])


def test_regions(spark):
    rng = random.Random(2)
    on = {(x, y) for x in range(14) for y in range(14) if rng.random() < 0.4}
    label, left = {}, set(on)
    while left:
        seed = min(left)
        queue, group = [seed], {seed}
        left.discard(seed)
        while queue:
            x, y = queue.pop()
            for p in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    group.add(p)
                    queue.append(p)
        label.update({p: min(group) for p in group})
    df = spark.createDataFrame([(1, x, y) for x, y in on], "image_id long, px long, py long")
    got = {(r.px, r.py): (r.region.x, r.region.y) for r in colors.connected_regions(df).collect()}
    assert got == label


def least_of_regions(on):
    label, left = {}, set(on)
    while left:
        queue = [left.pop()]
        for x, y in queue:
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            queue += near
        label |= dict.fromkeys(queue, min(queue))
    return label


def test_regions_across_tiles(spark):
    rng = random.Random(4)
    spiral, x, y, reach = {(0, 0)}, 0, 0, 2
    for turn in range(40):  # one region through many tiles and four signs
        for _ in range(reach):
            x, y = x + (1, 0, -1, 0)[turn % 4], y + (0, 1, 0, -1)[turn % 4]
            spiral.add((x, y))
        reach += 2 * (turn % 2)
    shapes = {
        1: {(x, y) for x in range(-30, 40) for y in range(-20, 30) if rng.random() < 0.32}, 2: spiral, None: {(15, 15), (16, 16), (18, 16)},
        3: {(15, 3), (16, 4), (2**60 + 15, 1), (2**60 + 16, 2)}, 4: {(x, y) for x in range(7) for y in range(4) if rng.random() < 0.4}}
    rows = [(i, x, y) for i, on in shapes.items() for x, y in on]
    rows += rows[:50] + [(1, None, 3), (1, None, 3), (1, None, 4)]
    df = spark.createDataFrame(rows, "image_id long, px long, py long")
    got = [(r.image_id, r.px, r.py, r.region.x, r.region.y) for r in colors.connected_regions(df).collect()]
    want = [(i, *p, *q) for i, on in shapes.items() for p, q in least_of_regions(on).items()] + [(1, None, y, None, y) for y in (3, 4)]
    assert len(got) == len(want) and set(got) == set(want)


def test_small_images_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "connected_components", lambda *a: pytest.fail("rounds over images of one tile"))
    on = [(i, x, y) for i in range(40) for x in range(7) for y in range(4) if (x * 5 + y * 3 + i) % 4 < 2]
    got = {(r.image_id, r.px, r.py): (r.region.x, r.region.y) for r in colors.connected_regions(
        spark.createDataFrame(on, "image_id long, px long, py long")).collect()}
    assert got == {(i, *p): q for i in range(40) for p, q in least_of_regions({(x, y) for j, x, y in on if j == i}).items()}


def test_repair(spark):
    base = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1e-10), (3, 1.0, 0.004), (4, 1.0, 1.0), (5, 0.0, 1.0)]
    points = spark.createDataFrame([(c, i, x, y, 1e-8 * (i > 2)) for c in (1, 2) for i, x, y in base], "contour_id long, idx long, x double, y double, z double")
    loops = spark.createDataFrame([(1, True, False), (2, True, True)], "contour_id long, closed boolean, explicit_closure boolean")
    fixed, log = repair.repair_points(points, loops, NO_SPLIT)
    rows = {c: sorted((r.idx, r.x, r.y) for r in fixed.collect() if r.contour_id == c) for c in (1, 2)}
    assert rows[1] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0), (4, 0.0, 0.0)]
    assert rows[2] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 0.0)]
    said = {(r.contour_id, r.step, r.operation.split()[0]) for r in log.collect()}
    assert said == {(c, s, w) for c, last in ((1, "append"), (2, "snap")) for s, w in ((1, "remove"), (2, "remove"), (3, "flatten"), (4, last))}


def test_merges(spark):
    rows = []
    for seg, (x0, x1) in enumerate([(0, 10), (10, 20), (20, 30), (60, 70)]):
        rows += [(1, seg, "line", i, float(x), 0.0, 0.1) for i, x in enumerate(np.linspace(x0, x1, 5))]
    df = spark.createDataFrame(rows, "contour_id long, segment long, type string, idx long, x double, y double, error double")
    names = lambda out: sorted({r.segment for r in out.collect()})
    assert names(segments.merge_adjacent(df.drop("error"), NO_SPLIT)) == [0, 2, 3]  # one pass pairs 0 with 1
    assert names(segments.merge_greedy(df, spans=NO_SPLIT)) == [0, 3]
    assert names(segments.merge_greedy(df, cap=1, spans=NO_SPLIT)) == [0]


def test_circle_and_line_tests(spark):
    arc = [(1, 0, i, 50 + 20 * math.cos(i / 8), 20 * math.sin(i / 8)) for i in range(20)]
    line = [(1, 1, i, float(i), 2.0 * i) for i in range(20)]
    df = spark.createDataFrame(arc + line, "contour_id long, segment long, idx long, x double, y double")
    fit = segments.circle_fit(df, spans=NO_SPLIT).filter("segment = 0").first()
    assert (fit.cx, fit.cy, fit.radius) == (pytest.approx(50), pytest.approx(0, abs=1e-9), pytest.approx(20))
    quality = segments.arc_quality(df, spans=NO_SPLIT).filter("segment = 0").first()
    assert quality.is_arc and quality.angle_span == pytest.approx(math.degrees(19 / 8)) and quality.sigma_c == pytest.approx(0, abs=1e-6)
    assert {r.segment: r.decision for r in segments.segment_decision(df, spans=NO_SPLIT).collect()} == {0: "arc", 1: "line"}


def test_area_is_stable_under_motion(spark, outline):
    moved = [(i, 3 + x * math.cos(1) - y * math.sin(1), x * math.sin(1) + y * math.cos(1) - 5) for i, x, y in outline]
    area = lambda rows: contours.signed_area(table(spark, rows), NO_SPLIT).first().signed_area
    assert area(moved) == pytest.approx(area(outline))


def test_hausdorff_is_symmetric(spark, outline):
    a = table(spark, outline, "pair_id")
    b = a.withColumn("x", F.col("x") + 0.5)
    assert fits.hausdorff(a, b).first()[1] == pytest.approx(fits.hausdorff(b, a).first()[1])


def test_long_runs_are_folded_in_blocks(spark, monkeypatch):
    """Thinning, minimum segment length and reading order of one long group equal the loop whatever the block."""
    rng = random.Random(8)
    path = [(1, i, round(i * 0.3 + rng.uniform(0, 0.2), 3), round(rng.uniform(0, 0.2), 3)) for i in range(90)]
    points = spark.createDataFrame(path, "contour_id long, idx long, x double, y double")
    kept = [path[0]]
    for p in path[1:]:
        if math.hypot(p[2] - kept[-1][2], p[3] - kept[-1][3]) > 1.0:
            kept.append(p)
    spots = [(1, i, rng.uniform(0, 50), i * 0.7) for i in range(80)]
    queue = sorted(spots, key=lambda r: (r[3], r[2], r[1]))
    for i in range(len(queue) - 1):
        a, b = queue[i], queue[i + 1]
        if abs(b[3] - a[3]) < 10 and b[2] < a[2]:
            queue[i], queue[i + 1] = b, a
    frame = spark.createDataFrame(spots, "image_id long, box_id long, x double, y double")
    zigzag = spark.createDataFrame([(1, i, float(i), float(rng.choice([0, 0, 3]))) for i in range(90)], "contour_id long, idx long, x double, y double")
    cuts = segments.split_min_points(zigzag, 0.3, 6, NO_SPLIT).cache()
    whole = as_set(cuts)
    monkeypatch.setattr(plan_blocks, "BLOCK", 11)
    assert {r.idx for r in repair.drop_duplicates_kept(points, 1.0, NO_SPLIT, close=False).collect()} == {p[1] for p in kept}
    assert {(r.place, r.box_id) for r in boxes.reading_order(frame, spans=NO_SPLIT).collect()} == {(i, b[1]) for i, b in enumerate(queue, 1)}
    monkeypatch.setattr(plan_blocks, "BLOCK", 3)
    assert as_set(segments.split_min_points(zigzag, 0.3, 6, NO_SPLIT)) == whole


def test_one_far_vertex_crowds_no_cell(spark):
    rng = random.Random(3)
    ring = [(math.cos(i / 500 * math.pi) + rng.uniform(0, 1e-3), math.sin(i / 500 * math.pi) + rng.uniform(0, 1e-3)) for i in range(1000)]
    near = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(ring)], "contour_id long, idx long, x double, y double")
    ring[700] = (1e5, 1e5)
    far = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(ring)], "contour_id long, idx long, x double, y double")
    for points in (near, far):
        edges = contours.outline_edges(points, "loop", NO_SPLIT)
        assert contours.near_edges(edges, 1e-7, NO_SPLIT).count() < 50 * 1000
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    pairs = 0
    for i in range(1000):
        a, b = ring[i], ring[(i + 1) % 1000]
        for j in range(i + 2, 1000 - (i == 0)):
            c, d = ring[j], ring[(j + 1) % 1000]
            pairs += cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0
    assert contours.self_intersections(far, "proper", NO_SPLIT).first().crossings == pairs > 0


def test_a_cycle_of_parents_has_no_ancestor(spark):
    rows = [(1, 2), (2, 4), (4, 6), (6, 2), (3, 8), (8, 5), (5, -1), (7, 10), (10, 10), (12, -1), (9, 12)]
    tree = contours.contour_depth_tree(spark.createDataFrame(rows, "id long, parent long"))
    assert {r.id: r.ancestor for r in tree.collect()} == {1: None, 3: 5, 5: None, 7: None, 9: None}


def test_common_subsequence_of_long_arrays(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(0, 70))], [rng.choice("abcde") for _ in range(rng.randrange(0, 70))]) for _ in range(40)]
    pairs.append((list("ab") * 50_000, list("ba") * 50_000))

    def loop(a, b):
        row = [0] * (len(b) + 1)
        for item in a:
            row = [0, *_grown(row, item, b)]
        return row[-1]

    def _grown(row, item, b):
        best = 0
        for j, other in enumerate(b, 1):
            best = max(best, row[j], row[j - 1] + 1 if item == other else 0)
            yield best

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<string>, b array<string>")
    got = {r.id: r.v for r in df.select("id", fits.lcs_ratio("a", "b").alias("v")).collect()}
    assert got.pop(40) == pytest.approx(99_999 / 100_000)
    for i, v in got.items():
        a, b = pairs[i]
        assert v == pytest.approx(loop(a, b) / max(len(a), len(b)) if a and b else float(not a and not b))
