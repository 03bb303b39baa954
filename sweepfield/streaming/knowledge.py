"""What a run's attempts teach, refreshed as each attempt arrives.

The state of a run is its last few attempts, kept by Spark's state store under
the run's key; nothing else of the history is read again. Every attempt adds
one row: its change against the attempt before, the counts and flags of the
recent window, and the recent distinct notes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sweepfield.operators.trials import OPERATIONS, change_columns, flag_columns
from sweepfield.streaming.trials import COMPACT_EVERY

PATTERN_WINDOW, NOTE_WINDOW, NOTES_KEPT = 5, 8, 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEASURES = ["s11", "frequency_error", "gain"]
ATTEMPT = "iteration long, s11 double, frequency_error double, gain double, operations array<string>, effect_available boolean, improved boolean, notes array<string>"
COUNTS = ["resize", "move", "add", "delete", "total", "available", "improved_count"]
EMITTED = "iteration long, has_before boolean, " + ", ".join(f"{m} double, {m}_before double" for m in MEASURES) + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", notes array<string>"


class RecentAttempts(StatefulProcessor):
    """Keeps the last attempts of one run and emits a row per new attempt."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", ATTEMPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = [f.split()[0] for f in ATTEMPT.split(", ")]
        fresh = [tuple(r) for part in rows for r in part[fields].itertuples(index=False)]
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        out, plain = [], lambda v: None if v is None or v != v else float(v)
        for attempt in sorted(fresh, key=lambda a: int(a[0])):
            if recent and int(attempt[0]) <= recent[-1][0]:
                continue
            kept = lambda items: [None if i is None else str(i) for i in items] if items is not None else []
            attempt = (int(attempt[0]), *map(plain, attempt[1:4]), kept(attempt[4]), bool(attempt[5]), bool(attempt[6]), kept(attempt[7]))
            before = recent[-1] if recent else None
            recent = [*recent, attempt][-max(PATTERN_WINDOW, NOTE_WINDOW):]
            window = recent[-PATTERN_WINDOW:]
            operations = [o for a in window for o in a[4]]
            notes = dict.fromkeys(n.strip() for a in recent[-NOTE_WINDOW:] for n in a[7] if n is not None and n.strip())
            out.append((
                *key, attempt[0], before is not None, *[v for i in (1, 2, 3) for v in (attempt[i], plain(before[i]) if before else None)],
                *[operations.count(n) for n in self.names], len(operations), sum(a[5] for a in window), sum(a[5] and a[6] for a in window),
                list(notes)[-NOTES_KEPT:]))
        if out:
            self.recent.put(recent)
            names = ["run_id", *[f.split()[0] for f in EMITTED.split(", ")]]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({m: "float64" for n in MEASURES for m in (n, f"{n}_before")})

    def close(self) -> None:
        pass


def knowledge(stream: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per attempt: changes, recent counts, flags, advice and notes as they stand after it.

    ``stream(run_id, iteration, s11, frequency_error, gain, operations, effect_available,
    improved, notes)``; other columns are ignored. A run's attempts arrive in the order of
    ``iteration``; inside one micro-batch any order will do. An attempt at or below the run's last
    one is taken for a repeat and adds nothing, nor does one without run or iteration. Null lists
    count as empty, null flags as false.
    """
    fields = [f.split()[0] for f in ATTEMPT.split(", ")]
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = stream.select("run_id", *[flag(c) if c in ("effect_available", "improved") else F.col(c) for c in fields]).filter("run_id IS NOT NULL AND iteration IS NOT NULL")
    schema = StructType([rows.schema["run_id"]])
    for field in StructType.fromDDL(EMITTED):
        schema = schema.add(field)
    met = rows.groupBy("run_id").transformWithStateInPandas(
        RecentAttempts(list(names or OPERATIONS)), outputStructType=schema, outputMode="Update", timeMode="None")
    changes = change_columns({m: F.col(m) for m in MEASURES}, {m: F.col(f"{m}_before") for m in MEASURES})
    weak, swing, dominant, advice = flag_columns()
    return met.select(
        "run_id", "iteration", *[F.when(F.col("has_before"), c).alias(n) for n, c in changes.items()], "resize", "move", "add", "delete",
        weak.alias("weak"), swing.alias("oscillation"), dominant.alias("dominant"), advice.alias("advice"), "notes")


def refresh_knowledge(
    stream: DataFrame, path: str, checkpoint: str, names: list[str] | None = None, trigger: dict | None = None, compact_every: int = COMPACT_EVERY
):
    """Write the rows of each micro-batch under its batch number; a restart goes on from the stored state.

    A repeated batch overwrites its own folder. Every ``compact_every`` batches the
    latest row of all runs is written whole.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
        if (batch + 1) % compact_every == 0:
            read_knowledge(rows.sparkSession, path).write.mode("overwrite").parquet(f"{path}/whole/batch={batch}")

    return (
        knowledge(stream, names).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_effects(spark, path: str) -> DataFrame:
    """The change of every attempt but each run's first."""
    return spark.read.parquet(f"{path}/changes").filter("s11_delta IS NOT NULL OR frequency_delta IS NOT NULL OR gain_delta IS NOT NULL").drop("batch")


def read_knowledge(spark, path: str) -> DataFrame:
    """Each run's latest row: from the last whole table and the changes after it."""
    rows = spark.read.parquet(f"{path}/changes")
    try:
        whole = spark.read.parquet(f"{path}/whole")
    except AnalysisException:  # none written yet
        whole = None
    if whole is not None:
        last = whole.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") > last).unionByName(whole.filter(F.col("batch") == last))
    rest = F.struct(*[c for c in rows.columns if c not in ("run_id", "batch")])
    return rows.groupBy("run_id").agg(F.max_by(rest, "iteration").alias("r")).select("run_id", "r.*")
