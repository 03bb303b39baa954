"""Files in, files out, and the streaming log."""

import json
import os
import random

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from sweepfield.operators import trials
from sweepfield.plans.ordered import NO_SPLIT
from sweepfield.plans.sizing import broadcast_if_small
from sweepfield.sources import payloads, sinks, sweeps
from sweepfield.streaming import trials as streaming

FILES = {
    "literal.txt": "[(1.0, (3+4j), 50.0), (2.0, 0.5-0.5j),\n (3.0, 0j, 1), (4.5, -7.5)]\n",
    "comma.csv": "﻿frequency,s11\n8.0,-3.0\nbad,row\n9.5, -14\n10,nan\n",
    "tabs.csv": "f\tdb\n1\t-2\n3\t-4.5\n",
    "prose.txt": "# export\nat 8.5 GHz level -12.25 dB\nonly 7\n9e0 and -1e1 and 5\n",
    "late.txt": "first line\n[(1.0, 2.0)]\n",
    "spread.txt": "[\n(1.0,\n(0.5+0j), 50.0),\n(2.0,\n(0.25 + 0j), 50.0)\n]\n",
    "broken.txt": "[(1.0, 2.0),\n3,4\n",
    "odd.txt": "[(1, (2, 3)), ('a', 2), (5,), [6, -7, 0], (8, None), (9, .5j)]",
}


def test_read_sweeps(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {}
    for row in sweeps.read_sweeps(spark, str(tmp_path)).collect():
        got.setdefault(os.path.basename(row.path), []).append((row.freq, round(row.value, 6)))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["literal.txt"] == [(1.0, pytest.approx(13.9794)), (2.0, pytest.approx(-3.0103)), (4.5, -7.5)]
    assert got["comma.csv"] == [(8.0, -3.0), (9.5, -14.0)]
    assert got["tabs.csv"] == [(1.0, -2.0), (3.0, -4.5)]
    assert got["prose.txt"] == [(8.5, -12.25), (9.0, -10.0)]
    assert got["late.txt"] == [(1.0, 2.0)]
    assert got["spread.txt"] == [(1.0, pytest.approx(-6.0206)), (2.0, pytest.approx(-12.0412))]
    assert got["broken.txt"] == [(3.0, 4.0)]  # no literal without its bracket
    assert got["odd.txt"] == [(6.0, -7.0), (9.0, pytest.approx(-6.0206))]


def test_latest_file(spark, tmp_path):
    for i, name in enumerate(["s11.csv", "x_S11_y.txt", "other.csv"]):
        (tmp_path / name).write_text("1,2")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    files = sweeps.list_files(spark, str(tmp_path)).withColumn("run", F.lit(1))
    assert sweeps.latest_file_per_group(files, ["run"]).first().path.endswith("x_S11_y.txt")


def test_history_and_records(spark, tmp_path):
    rows = [(1, 4.5, 2.25, -11.0, 0.5, "completed", 1.5, None), (2, 5.0, None, None, None, "failed", 2.0, None), (3, 5.0, None, None, None, "failed", 2.0, "boom")]
    df = spark.createDataFrame(rows, "iteration int, patch_length double, f_resonance double, min_s11 double, objective_value double, status string, simulation_time double, error_message string")
    df = df.withColumn("json_path", F.lit(None).cast("string")).withColumn("s11_path", F.lit(None).cast("string"))
    sinks.write_history(df, f"{tmp_path}/history")
    first = spark.read.option("header", "true").csv(f"{tmp_path}/history").filter("iteration = 1").first()
    assert list(first.asDict()) == list(sinks.HISTORY) and first.patch_length == "4.500000" and first.min_s11 == "-11.000000000"
    sinks.write_json_records(df, str(tmp_path / "records"))
    failed = spark.read.json(f"{tmp_path}/records/failed")
    assert {(r.iteration, r.error_message) for r in failed.collect()} == {(2, "failed"), (3, "boom")}


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"components": [{"closed": True, "points": [[0, 0], ["x", 1], [1, 2, 3]]}]}, indent=2))
    (tmp_path / "b.json").write_text("[1, 2]")
    (tmp_path / "c.json").write_text("")
    loaded = payloads.load_payloads(spark, str(tmp_path))
    points = sorted((r.idx, r.x, r.y, r.z) for r in payloads.explode_points(loaded).collect())
    assert points == [(0, 0.0, 0.0, 0.0), (1, 1.0, 2.0, 3.0)]
    counts = {r.design_id[-6:]: r.component_count for r in payloads.parameterization_summary(loaded).collect()}
    assert counts["a.json"] == 1 and counts.get("b.json") == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    text = "run_id long, evaluation long, objective double, status string"
    rows = [(rng.randrange(5), i, rng.choice([rng.random(), float("nan")]), rng.choice(["failed", "completed"])) for i in range(90)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], text).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(text).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.append_trials(stream, f"{tmp_path}/log", f"{tmp_path}/s1").awaitTermination()
    for _ in range(2):  # a restart with nothing new changes nothing
        streaming.refresh_best(stream, f"{tmp_path}/best", f"{tmp_path}/s2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 90
    got = {(r.run_id, r.best, r.best_evaluation, r.trials) for r in streaming.read_best(spark, f"{tmp_path}/best").collect()}
    batch = trials.best_so_far(spark.createDataFrame(rows, text), NO_SPLIT).groupBy("run_id").agg(
        F.max_by(F.struct("best", "best_evaluation"), "evaluation").alias("b"), F.count(F.lit(1)).alias("n"))
    assert got == {(r.run_id, r.b.best, r.b.best_evaluation, r.n) for r in batch.collect()}
    bests = trials.best_so_far(spark.createDataFrame(rows, text), NO_SPLIT).filter("best is not null").orderBy("run_id", "evaluation").collect()
    assert all(a.best >= b.best for a, b in zip(bests, bests[1:]) if a.run_id == b.run_id)


def test_broadcast_needs_a_count(spark, tmp_path):
    spark.range(2000).write.parquet(f"{tmp_path}/ids")
    table = spark.read.parquet(f"{tmp_path}/ids")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert not hinted(broadcast_if_small(table, 10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert hinted(broadcast_if_small(table, 5000)) and not hinted(broadcast_if_small(table, 1999))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_of_curves(spark):
    from sweepfield.operators import curves

    empty = spark.createDataFrame([], "design_id long, freq double, value double")
    assert curves.local_minima(empty, NO_SPLIT).count() == 0 and curves.widest_band(empty, -10.0, NO_SPLIT).count() == 0
    one = spark.createDataFrame([(1, 2.0, -30.0)], "design_id long, freq double, value double")
    assert as_set(curves.widest_band(one, -10.0, NO_SPLIT)) == {(2.0, 2.0, 0.0, 1)}


def test_payloads_are_written_as_files(spark, tmp_path):
    rows = [(1, '{"components": []}'), (2, None), (3, '{"components": [{"points": [[0, 0], [1, 2]]}]}\n'), (4, "[1, 2"), (5, "")]
    docs = spark.createDataFrame(rows, "design_id long, doc string")
    payloads.write_payloads(docs, f"file:{tmp_path}/export")
    files = [f for f in (tmp_path / "export").rglob("*") if f.is_file()]
    # One file a design, moved into place by its task, without a folder or a checksum file of its own.
    assert {f.name: f.read_text() for f in files} == {f"design_id={k}.json": (v or "") + "\n" for k, v in rows}
    counts = {r.design_id.rsplit("/", 1)[1]: r.component_count for r in payloads.parameterization_summary(payloads.load_payloads(spark, f"{tmp_path}/export")).collect()}
    assert counts == {f"design_id={k}.json": int(k == 3) for k, _ in rows}
    # Elsewhere than on a mounted disk Spark writes, one file a design too.
    payloads.write_payloads(docs, f"{tmp_path}/spark")
    loaded = payloads.load_payloads(spark, f"{tmp_path}/spark")
    assert sorted(r.component_count for r in payloads.parameterization_summary(loaded).collect()) == [0, 0, 0, 0, 1]
