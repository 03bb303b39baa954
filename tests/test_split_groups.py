"""A group cut into spans must give exactly what one window gives."""

import random

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from sweepfield.operators import boxes, contours, curves, edits, fits, repair, segments, trials
from sweepfield.plans.ordered import NO_SPLIT, measure_spans, with_group, with_neighbours, with_running


@pytest.fixture(scope="module")
def sweep_rows():
    rng = random.Random(3)
    rows = []
    for design, size in ((1, 400), (2, 3), (3, 2), (4, 1), (5, 60)):
        freqs = sorted(rng.sample(range(4000), size))
        # Few levels, so that plateaus of every length occur, also across span borders.
        rows += [(design, f / 10, float(rng.choice([-30, -20, -20, -20, -10, -5]))) for f in freqs]
    rows += [(6, float(i), -12.0) for i in range(200)]
    return rows


@pytest.fixture(scope="module")
def sweeps(spark, sweep_rows):
    return spark.createDataFrame(sweep_rows, "design_id long, freq double, value double")


def spans_of(df, keys, order, rows=17):
    found = measure_spans(df, keys, order, rows_per_span=rows)
    assert found
    return found


def test_measure_finds_only_large_groups(sweeps):
    found = measure_spans(sweeps, ["design_id"], "freq", rows_per_span=100)
    assert {r.design_id for r in found.borders.collect()} == {1, 6}
    assert not measure_spans(sweeps, ["design_id"], "freq", rows_per_span=1000)


def test_many_large_groups_with_crowded_order(spark):
    rng = random.Random(5)
    rows = []
    for design in range(300):
        # Nearly all samples crowd into one stretch; some tie.
        freqs = [rng.choice([1.0, 1.0 + rng.random() / 1000]) for _ in range(38)] + [1e6, 2e6]
        rows += [(design, i, f, float(i)) for i, f in enumerate(sorted(freqs))]
    rows += [(None, i, float(i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "design_id long, idx long, freq double, value double")
    spans = measure_spans(df, ["design_id"], "freq", rows_per_span=10)
    assert spans.borders.count() == 301
    sizes = spans.cut(df, ["design_id"], "freq").groupBy("design_id", "_span").count()
    spread = sizes.groupBy("design_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    assert spread >= 2
    order = ["freq", "idx"]
    make = lambda s: with_neighbours(df, ["design_id"], order, ["freq", "value"], s)
    assert as_set(flat(make(NO_SPLIT))) == as_set(flat(make(spans)))
    run = lambda s: with_running(df, ["design_id"], order, {"total": ("sum", F.col("value"))}, s)
    assert as_set(run(NO_SPLIT)) == as_set(run(spans))
    with pytest.raises(ValueError):
        with_running(df, ["idx"], order, {"total": ("sum", F.col("value"))}, spans)


def test_groups_beyond_one_fan_are_cut_again(spark, monkeypatch):
    from sweepfield.plans import ordered

    monkeypatch.setattr(ordered, "FAN", 4)
    df = spark.range(2000).select(F.lit(1).cast("long").alias("g"), F.col("id").cast("double").alias("at"))
    spans = measure_spans(df, ["g"], "at", rows_per_span=50)
    largest = spans.cut(df, ["g"], "at").groupBy("_span").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 50


def test_primitives_match_plain_windows(spark, sweeps):
    spans = spans_of(sweeps, ["design_id"], "freq")
    for cyclic in (False, True):
        make = lambda s: with_neighbours(sweeps, ["design_id"], ["freq"], ["freq", "value"], s, cyclic=cyclic)
        assert as_set(flat(make(NO_SPLIT))) == as_set(flat(make(spans)))
    totals = {"n": ("sum", F.lit(1)), "low": ("min", F.struct("value", "freq")), "top": ("max", F.col("value"))}
    for reverse in (False, True):
        make = lambda s: with_running(sweeps, ["design_id"], ["freq"], totals, s, reverse)
        assert as_set(make(NO_SPLIT)) == as_set(make(spans))
    make = lambda s: with_group(sweeps, ["design_id"], {"n": F.count(F.lit(1)), "low": F.min("value")}, s)
    assert as_set(make(NO_SPLIT)) == as_set(make(spans))


def flat(df):
    return df.select("design_id", "freq", "value", F.col("prev.freq").alias("pf"), F.col("prev.value").alias("pv"),
                     F.col("next.freq").alias("nf"), F.col("next.value").alias("nv"))


def brute_minima(rows):
    if len(rows) < 3:
        return list(rows)
    found, i = [], 1
    while i < len(rows) - 1:
        j = i + 1
        while j < len(rows) and rows[j][1] == rows[i][1]:
            j += 1
        if j == len(rows):
            break
        left, here, right = rows[i - 1][1], rows[i][1], rows[j][1]
        if here <= min(left, right) and here < max(left, right):
            found.append(rows[i + (j - i) // 2])
        i = j
    return found


def test_local_minima_against_loop(sweeps, sweep_rows):
    spans = spans_of(sweeps, ["design_id"], "freq")
    want = set()
    for design in {r[0] for r in sweep_rows}:
        curve = [(f, v) for d, f, v in sweep_rows if d == design]
        want |= {(design, f, v) for f, v in brute_minima(curve)}
    for s in (NO_SPLIT, spans):
        assert as_set(curves.local_minima(sweeps, s).select("design_id", F.col("freq").alias("e"), F.col("value").alias("f"))) == want


@pytest.mark.parametrize("name", ["below_threshold_bands", "interpolated_bands", "widest_band", "resonances"])
def test_curve_operators(sweeps, name):
    spans = spans_of(sweeps, ["design_id"], "freq")
    kwargs = {"threshold": -20.0}
    operator = getattr(curves, name)
    assert as_set(operator(sweeps, spans=NO_SPLIT, **kwargs)) == as_set(operator(sweeps, spans=spans, **kwargs))


def test_curve_metrics(spark, sweeps):
    spans = spans_of(sweeps, ["design_id"], "freq")
    targets = spark.createDataFrame([(d, 150.0, 5.0, 7.0) for d in range(1, 7)], "design_id long, target_freq double, target_bandwidth double, gain double")
    make = lambda s: curves.curve_metrics(sweeps, targets, -20.0, 2, s).withColumn("resonances", F.col("resonances").cast("string"))
    assert as_set(make(NO_SPLIT)) == as_set(make(spans))
    make = lambda s: curves.simulation_summary(sweeps, targets, spans=s).select("design_id", "current.*", "gap_to_target.*", "passed.overall")
    assert as_set(make(NO_SPLIT)) == as_set(make(spans))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = []
    for contour, size in ((1, 300), (2, 3), (3, 70), (4, 1)):
        x = y = 0.0
        for i in range(size):
            x, y = x + rng.uniform(-1, 1.5), y + rng.uniform(-1, 1)
            rows.append((contour, i, round(x, 4), round(y, 4)))
    return spark.createDataFrame(rows, "contour_id long, idx long, x double, y double").cache()


OUTLINES = {
    "signed_area": lambda p, s: contours.signed_area(p, s),
    "length": lambda p, s: contours.polyline_length(p, True, s),
    "edge_stats": lambda p, s: contours.edge_stats(p, 0.5, True, s),
    "duplicates": lambda p, s: contours.grid_duplicates(p, 0.5, s),
    "gap": lambda p, s: contours.minimum_gap(p, s),
    "crossings": lambda p, s: contours.self_intersections(p, "touch", s),
    "continuity": lambda p, s: contours.curvature_continuity(p, s),
    "right_angles": lambda p, s: contours.right_angle_ratio(p, s),
    "turns": lambda p, s: contours.turning_angles(p, s),
    "densify": lambda p, s: contours.densify(p, 100, s),
    "rectangle": lambda p, s: contours.is_rectangle(p, s),
    "kept": lambda p, s: repair.drop_duplicates_kept(p, 0.8, s),
    "split": lambda p, s: segments.split_on_curvature(p, spans=s),
    "split_min": lambda p, s: segments.split_min_points(p, 0.9, 5, s),
    "variants": lambda p, s: edits.random_variants(p, 2, 4, spans=s),
    "arc": lambda p, s: segments.arc_quality(p.withColumn("segment", F.lit(0).cast("long")), 9.0, 99.0, 0.0, s).drop("cx", "cy"),
}


@pytest.mark.parametrize("name", OUTLINES)
def test_outline_operators(points, name):
    spans = spans_of(points, ["contour_id"], "idx", 23)
    operator = OUTLINES[name]
    assert as_set(operator(points, NO_SPLIT), 6) == as_set(operator(points, spans), 6)


def test_trial_and_text_operators(spark):
    rng = random.Random(8)
    rows = [(run, i, rng.choice([rng.random(), float("nan"), 0.5])) for run, n in ((1, 200), (2, 4)) for i in range(1, n + 1)]
    log = spark.createDataFrame(rows, "run_id long, evaluation long, objective double")
    spans = spans_of(log, ["run_id"], "evaluation")
    pick = lambda s: trials.best_so_far(log, s).select("run_id", "evaluation", "best", "best_evaluation")
    assert as_set(pick(NO_SPLIT)) == as_set(pick(spans))
    marks = [(run, rng.randrange(50) / 50, rng.randrange(2)) for run, n in ((1, 300), (2, 5)) for _ in range(n)]
    table = spark.createDataFrame(marks, "sample_id long, boundary double, kind int")
    spans = spans_of(table, ["sample_id"], "boundary")
    truth, guess = table.filter("kind = 1").drop("kind"), table.filter("kind = 0").drop("kind")
    assert as_set(fits.breakpoint_mae(truth, guess, spans=NO_SPLIT)) == as_set(fits.breakpoint_mae(truth, guess, spans=spans))


def test_box_orders(spark):
    rng = random.Random(9)
    rows = [(1, i, float(rng.randrange(300)), float(rng.randrange(2000))) for i in range(400)]
    table = spark.createDataFrame(rows, "image_id long, box_id long, x double, y double")
    spans = spans_of(table, ["image_id"], "y")
    assert as_set(boxes.reading_order(table, spans=NO_SPLIT)) == as_set(boxes.reading_order(table, spans=spans))
