"""What is costly to make is made once: files opened, cuts searched, arrivals written side by side."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from sweepfield.operators import repair, segments  # noqa: E402
from sweepfield.session import shared_folder  # noqa: E402
from sweepfield.sources import payloads, sweeps  # noqa: E402

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1;2\n3;4\n")
    (tmp_path / "b.txt").write_text("[(1, 2),\n (3, 4)]\n")
    out = sweeps.read_sweeps(spark, str(tmp_path))
    assert "Relation" not in plan_of(out)
    assert sorted((r.freq, r.value) for r in out.collect()) == [(1.0, 2.0)] * 2 + [(3.0, 4.0)] * 2
    assert "Relation" not in plan_of(payloads.load_payloads(spark, str(tmp_path)))


def test_cuts_are_searched_once(spark):
    points = spark.createDataFrame([(1, i, float(i), float(i % 12 > 5)) for i in range(60)], "contour_id long, idx long, x double, y double")
    out = segments.split_min_points(points)
    # Only the last numbering of segments is left to do.
    assert "MapInPandas" not in plan_of(out) and out.count() > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_arrivals_are_written_side_by_side(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("knowledge-*/arriving/*.parquet"))
    entry.queries()["refresh_knowledge"](spark, DATA)
    assert len(set(folder.rglob("knowledge-*/arriving/*.parquet")) - before) > 6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_replies_are_judged_once(spark):
    plan = plan_of(entry.queries()["route_replies"](spark, DATA))
    assert plan.count("Relation") == 1 and "Union" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_trials_arrive_side_by_side(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("stream-*/arriving/*.parquet"))
    entry.queries()["append_trials"](spark, DATA)
    assert len(set(folder.rglob("stream-*/arriving/*.parquet")) - before) > 6


def test_points_are_thinned_once(spark):
    points = spark.createDataFrame([(1, i, float(i // 2), float(i % 3), 0.0) for i in range(12)], "contour_id long, idx long, x double, y double, z double")
    loops = spark.createDataFrame([(1, True, False)], "contour_id long, closed boolean, explicit_closure boolean")
    fixed, log = repair.repair_points(points, loops)
    assert "InPandas" not in plan_of(fixed) + plan_of(log) and "InArrow" not in plan_of(fixed) + plan_of(log)
    assert fixed.count() > 6


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.json").write_text("{}")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    loaded = payloads.load_payloads(spark, str(tmp_path))
    assert loaded._jdf.queryExecution().toRdd().getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert loaded.count() == 600 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    lone = spark.createDataFrame([], "design_id long, doc string")
    payloads.write_payloads(lone, f"file:{tmp_path}/none")
    assert not [f for f in (tmp_path / "none").rglob("*") if f.is_file()]
