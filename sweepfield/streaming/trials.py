"""Trial log as a stream: append each evaluation and keep every run's best current."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPACT_EVERY = 32


def append_trials(stream: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None):
    """Append every new trial to a Parquet log, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", log_path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def running_best(stream: DataFrame) -> DataFrame:
    """Best objective, its evaluation and counts of every run so far.

    A streaming aggregate: the state is one row per run, kept by Spark. The
    rule has no event time, so there is no watermark.
    """
    usable = F.col("objective").isNotNull() & ~F.isnan("objective") & (F.abs("objective") < float("inf"))
    best = F.min(F.when(usable, F.struct("objective", "evaluation")))
    return stream.groupBy("run_id").agg(
        best.alias("_best"), F.count(F.lit(1)).alias("trials"), F.count_if(F.col("status") == "failed").alias("failed")
    ).select("run_id", F.col("_best.objective").alias("best"), F.col("_best.evaluation").alias("best_evaluation"), "trials", "failed")


def refresh_best(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY):
    """Write the changed runs of each micro-batch under its batch number.

    A repeated batch overwrites its own folder, so a restart changes nothing.
    Every ``compact_every`` batches the best of all runs is written whole, so
    ``read_best`` reads one whole table and a few batches of changes however
    long the stream has run.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
        if (batch + 1) % compact_every == 0:
            read_best(rows.sparkSession, path).write.mode("overwrite").parquet(f"{path}/whole/batch={batch}")

    return (
        running_best(stream).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_best(spark, path: str) -> DataFrame:
    """Current best of every run: the last whole table and the changes after it."""
    rows = spark.read.parquet(f"{path}/changes")
    try:
        whole = spark.read.parquet(f"{path}/whole")
    except AnalysisException:  # none written yet
        whole = None
    if whole is not None:
        last = whole.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") > last).unionByName(whole.filter(F.col("batch") == last))
    rest = F.struct(*[c for c in rows.columns if c not in ("run_id", "batch")])
    return rows.groupBy("run_id").agg(F.max_by(rest, "batch").alias("r")).select("run_id", "r.*")
