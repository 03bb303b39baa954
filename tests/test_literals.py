"""Small inputs with known answers."""

import numpy as np
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from sweepfield.operators import colors, contours, curves, fits, objectives, primitives, text, trials
from sweepfield.plans.ordered import NO_SPLIT

TWO_DIPS = [(8, -3), (9, -14), (9.5, -6), (10, -8), (10.6, -22), (11.2, -7), (12, -4)]
SHALLOW = [(8, -2), (9, -8), (9.5, -5), (10, -32), (10.5, -6), (11, -9), (12, -3)]
BANDS = [(8, -3), (9, -14), (9.1, -13), (9.2, -5), (10, -12), (10.3, -11), (10.6, -10.5), (10.9, -4)]


def curve(spark, rows, design=1):
    return spark.createDataFrame([(design, float(f), float(v)) for f, v in rows], "design_id long, freq double, value double")


def test_resonances_and_bands(spark):
    both = curve(spark, TWO_DIPS)
    assert [tuple(r) for r in curves.global_minimum(both).collect()] == [(1, 10.6, -22.0)]
    found = lambda rows: sorted(r.freq for r in curves.resonances(curve(spark, rows), spans=NO_SPLIT).collect())
    assert found(TWO_DIPS) == [9.0, 10.6]
    assert found(SHALLOW) == [10.0]
    band = curves.widest_band(curve(spark, BANDS), -10.0, NO_SPLIT).first()
    assert (band.band_start, band.band_end) == (10.0, 10.6) and band.bandwidth == pytest.approx(0.6)
    assert curves.resonances(both, limit=0, spans=NO_SPLIT).count() == 0


def test_interpolation_clamps(spark):
    targets = spark.createDataFrame([(1, 7.0)], "design_id long, target_freq double")
    value = lambda t: curves.interpolate_at(curve(spark, TWO_DIPS), targets.withColumn("target_freq", F.lit(t))).first().value_at_target
    assert value(7.0) == -3.0 and value(20.0) == -4.0 and value(9.0) == -14.0
    assert value(9.25) == pytest.approx(-10.0)


def test_objective_errors(spark):
    row = spark.range(1).select(
        objectives.multi_resonance_error(F.array(F.lit(9.4), F.lit(10.8)), F.array(F.lit(9.5), F.lit(10.5))).alias("both"),
        objectives.multi_resonance_error(F.array(F.lit(9.5)), F.array(F.lit(9.5), F.lit(10.5))).alias("missing"),
        objectives.multi_resonance_error(F.array(F.lit(9.5)), F.array(F.lit(0.0))).alias("off"),
        objectives.threshold_error(F.lit(-13.0), F.lit(-10.0)).alias("fine"),
        objectives.relative_error(F.lit(None).cast("double"), F.lit(1.0)).alias("unknown"),
    ).first()
    assert row.both == pytest.approx((0.1 / 9.5 + 0.3 / 10.5) / 2)
    assert row.missing == pytest.approx(0.5) and row.off is None and row.fine == 0.0 and row.unknown is None


@pytest.mark.parametrize("level, error", [(-9.0, 0.1), (0.0, 1.0), (-12.0, 0.0)])
def test_band_compliance(spark, level, error):
    samples = curve(spark, [(f, level) for f in (1, 2, 3, 4)])
    bands = spark.createDataFrame([(1, 1.0, 4.0), (2, 1.0, 4.0), (3, 4.0, 1.0)], "design_id long, band_start double, band_end double")
    out = {r.design_id: (r.compliance_error, r.sample_count) for r in objectives.band_compliance(samples, bands).collect()}
    assert out[1] == (pytest.approx(error), 4) and out[2] == (1.0, 0) and out[3] == (None, 0)


def test_port_walk(spark):
    ports = spark.createDataFrame([(1, "bottom", 50.0, 100.0, 10.0), (2, "left", 0.0, 0.0, 4.0)],
                                  "design_id long, side string, port_x double, port_y double, port_width double")
    edges = spark.createDataFrame([(1, 0.0, 95.9, 100.0, 95.9), (1, 3.0, 3.0, 4.0, 4.0), (2, 130.0, -5.0, 130.0, 5.0)],
                                  "design_id long, x1 double, y1 double, x2 double, y2 double")
    out = {r.design_id: r for r in primitives.connect_port(ports, edges).collect()}
    assert out[1].status == "connected_by_inward_shift" and out[1].shift == pytest.approx(4.0)
    assert (out[1].point_x, out[1].point_y, out[1].width) == (50.0, pytest.approx(96.0), 15.0)
    assert out[2].status == "failed_no_curve_contact_within_max_shift" and out[2].shift == pytest.approx(120.0)


def test_port_sides(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 50.0, "bottom")], "design_id long, min_x double, min_y double, max_x double, max_y double, side string")
    zones = primitives.port_zones(box)
    rows = spark.createDataFrame(
        [(1, "left", "LINE", 1.0, 25.0, 0.0, 0.0, 0.0, 50.0), (1, "low", "LINE", 50.0, 49.0, 0.0, 49.0, 100.0, 49.0)],
        "design_id long, primitive_id string, type string, cx double, cy double, x1 double, y1 double, x2 double, y2 double")
    out = {r.primitive_id: r.role for r in primitives.primitive_role(rows, zones).collect()}
    assert out["left"] != "PORT" and out["low"] == "PORT"


def test_fit_helpers(spark):
    row = spark.range(1).select(
        fits.lcs_ratio(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("c"))).alias("lcs"),
        fits.lcs_ratio(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("empty"),
        fits.parsimony_score(F.lit(10), F.lit(5)).alias("p"),
    ).first()
    assert row.lcs == pytest.approx(2 / 3) and row.empty == 1.0 and row.p == pytest.approx(0.68)


def test_level_report_window(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2 == 0) for i in range(30)], "idx long, level int, passed boolean")
    out = fits.level_report(rows, [1, 2], start=3, limit=10).agg(F.sum("total")).first()[0]
    assert out == 10


def test_variable_cap(spark):
    rows = spark.createDataFrame(
        [(1, f"p-{i}", i, t, "STRUCTURAL", 0.0, 0.0, 4.0, 2.0, 4.0) for i, t in enumerate(["LINE", "HOLE", "LINE"])],
        "design_id long, primitive_id string, seq int, type string, role string, min_x double, min_y double, max_x double, max_y double, length double")
    box = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 40.0)], "design_id long, min_x double, min_y double, max_x double, max_y double")
    names = lambda cap: [r.name for r in primitives.variable_plan_primitives(rows, box, cap).orderBy("kind", "seq", "part").collect()]
    assert names(None)[:4] == [f"p_1_slot_{s}" for s in ("translate_x", "translate_y", "width_delta", "height_delta")]
    assert names(5) == names(None)[:5] and len(names(None)) == 6


def test_cluster_vote():
    assert colors.vote_clusters([100, 40, 30, 28], [0, 0.9, 0.5, 0.4], [0, 5, 9, 8], 4) in (2, 3)
    assert colors.vote_clusters([100, 40, 30, 28], [0, 0.9, 0.5, 0.4], [0, 5, 4, 3], 4, "most") == 2


def test_each_image_has_its_own_palette(spark):
    def image(i, blocks):
        return [(i, x, y, *blocks[(x // 10) % len(blocks)]) for x in range(40) for y in range(12)]

    rows = image(1, [(250, 10, 10), (10, 10, 250)]) + image(2, [(0, 0, 0), (128, 128, 128), (255, 255, 255), (0, 200, 0)]) + image(3, [(7, 7, 7)])
    df = spark.createDataFrame(rows, "image_id long, px long, py long, r int, g int, b int")
    out = colors.quantize_colors(df).collect()
    assert len(out) == len(rows)
    seen = lambda i: {tuple(r.palette) for r in out if r.image_id == i}
    assert seen(1) == {(250, 10, 10), (10, 10, 250)} and seen(3) == {(7, 7, 7)}
    assert 2 <= len(seen(2)) <= 4 and all(len({r.cluster for r in out if r.image_id == 2 and (r.r, r.g, r.b) == c}) == 1 for c in [(0, 0, 0), (0, 200, 0)])
    assert abs(colors.lab_of(np.array([255.0, 255.0, 255.0]))[0] - 255) < 0.5


def test_next_iteration_empty(spark):
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id long")
    log = spark.createDataFrame([(1, "4"), (1, "x"), (2, "x")], "run_id long, iteration string")
    assert as_set(trials.next_iteration(runs, log)) == {(5, 1), (2, 2), (1, 3)}


def test_reply_dictionary(spark):
    reply = "text fss_size = {'X': '23', \"Y\": 23.5, 'Z': 'unknown'} more {'X': 1}"
    row = spark.createDataFrame([(reply,), ("none",)], "r string").select(text.reply_dict(F.col("r")).alias("d")).collect()
    assert row[0].d == {"X": "23", "Y": "23.5", "Z": "unknown", "Unit": "unknown"} and row[1].d is None
    sizes = text.fill_defaults(F.create_map(F.lit("X"), F.lit("23"), F.lit("Z"), F.lit("unknown")))
    out = spark.range(1).select(*[v.alias(k) for k, v in sizes.items()]).first()
    assert (out.X, out.Y, out.Z) == (23.0, None, 1.6)


def test_densify_two_points(spark):
    pair = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 2.0)], "contour_id long, idx long, x double, y double")
    out = sorted((r.idx, r.x, r.y) for r in contours.densify(pair, 5, NO_SPLIT).collect())
    assert out == [(i, float(i), i / 2) for i in range(5)]
