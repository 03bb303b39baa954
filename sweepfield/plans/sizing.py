"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def _estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _automatic_limit(df: DataFrame) -> int:
    jvm = df.sparkSession._jvm
    return int(jvm.org.apache.spark.sql.internal.SQLConf.get().autoBroadcastJoinThreshold())


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow table when a bounded count proves it small.

    Tables below Spark's own threshold need no hint and no count. Tables above
    the row limit are left to a shuffled join, which AQE splits on hot keys.
    """
    if _estimated_bytes(df) <= _automatic_limit(df):
        return df
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
