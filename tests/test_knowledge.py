"""Refreshed knowledge of the stream against the batch operators, over a restart."""

import random

from pyspark.sql import functions as F

from sweepfield.operators import trials
from sweepfield.plans.ordered import NO_SPLIT
from sweepfield.streaming import knowledge

SCHEMA = ("run_id long, iteration long, s11 double, frequency_error double, gain double, operations array<string>, "
          "effect_available boolean, improved boolean, notes array<string>, batch string")


def attempts(seed):
    rng = random.Random(seed)
    number = lambda: rng.choice([None, float("nan"), round(rng.uniform(-20, 5), 2), round(rng.uniform(-20, 5), 2)])
    rows = []
    for iteration in range(24):
        for run in [None, 1, 2, 3]:
            if rng.random() < 0.8:
                rows.append((run, iteration, number(), number(), number(), rng.choices(trials.OPERATIONS, k=rng.randint(0, 3)) or None,
                             rng.choice([True, True, None]), rng.choice([True, False, None]), rng.choice([None, [], [" a", "b ", "", None], [f"n{iteration}", "a"]]), "x"))
    return rows


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = attempts(4)
    for part in range(6):
        own = [r for r in rows if r[1] * 6 // 24 == part]
        repeat = [r for r in rows if r[1] == 3] if part == 4 else []  # attempts seen before add nothing
        spark.createDataFrame((own + repeat)[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (2, 5):
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            knowledge.refresh_knowledge(stream, f"{tmp_path}/out", f"{tmp_path}/state", compact_every=4).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA).filter("run_id IS NOT NULL").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("effect_available", "improved")}).withColumn(
        "operations", F.coalesce("operations", F.array().cast("array<string>")))
    latest = knowledge.read_knowledge(spark, f"{tmp_path}/out").cache()
    flags = ["run_id", "resize", "move", "add", "delete", "weak", "oscillation", "dominant", "advice"]
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert plain(latest.select(flags)) == plain(trials.pattern_flags(whole).select(flags))
    effects = knowledge.read_effects(spark, f"{tmp_path}/out")
    batch = trials.effect_deltas(whole, NO_SPLIT).filter("s11_delta IS NOT NULL OR frequency_delta IS NOT NULL OR gain_delta IS NOT NULL")
    assert plain(effects.select(batch.columns)) == plain(batch) and batch.count() > 10
    notes = latest.select("run_id", F.posexplode("notes").alias("rank", "text")).withColumn("rank", F.col("rank") + 1)
    assert plain(notes) == plain(trials.distinct_in_order(whole, "notes"))
