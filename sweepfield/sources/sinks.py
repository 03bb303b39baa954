"""Writing trial logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepfield.operators.trials import split_outcomes

# Very many small files: each task moves its own into place, else the driver moves all, one by one.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

# History columns and their decimals.
HISTORY = {
    "iteration": None, "patch_length": 6, "f_resonance": 9, "min_s11": 9, "objective_value": 9, "status": None, "simulation_time": 3,
}


def history_rows(trials: DataFrame) -> DataFrame:
    """The seven history columns as text with fixed decimals; unknown numbers are empty."""
    text = lambda name, digits: F.when(F.col(name).isNull(), "").otherwise(
        F.format_string(f"%.{digits}f", F.col(name).cast("double"))
    )
    return trials.select(*[F.col(n) if d is None else text(n, d).alias(n) for n, d in HISTORY.items()])


def write_history(trials: DataFrame, path: str, mode: str = "append") -> None:
    """History as CSV with a header, one file per task."""
    history_rows(trials).write.mode(mode).option("header", "true").csv(path)


def success_records(trials: DataFrame) -> DataFrame:
    done, _ = split_outcomes(trials)
    return done.select(
        "iteration", F.struct("patch_length").alias("parameters"), "f_resonance", "min_s11", "objective_value", "json_path", "s11_path"
    )


def failed_records(trials: DataFrame) -> DataFrame:
    _, failed = split_outcomes(trials)
    return failed.select("iteration", F.struct("patch_length").alias("parameters"), "error_message", "objective_value", "json_path", "s11_path")


def write_json_records(trials: DataFrame, path: str, mode: str = "append") -> None:
    """Success and failure records as JSON lines in two folders, nulls kept."""
    for name, records in (("success", success_records(trials)), ("failed", failed_records(trials))):
        records.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/{name}")
