"""Session helpers: settings the operators rely on, and the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when that costs one more exchange later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Reduce tasks may stay small: the joins on grid cells cost far more
    # time per byte than AQE assumes when it merges small partitions.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Spark plans a join from file sizes, which say nothing of the rows that an explode
# makes. Tables derived that way are broadcast by the measured size of their shuffle only.
MEASURED_JOINS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
ESTIMATED_JOINS = {name: "10MB" for name in MEASURED_JOINS}


def apply_settings(spark: SparkSession, joins: dict[str, str] = ESTIMATED_JOINS) -> SparkSession:
    for name, value in {**RUNTIME_SETTINGS, **joins}.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "sweepfield", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster, as set in ``spark.checkpoint.dir``.

    Only a single-machine session may do without the setting: it gets a folder
    of its own under /tmp. On a cluster a missing setting is an error, since
    hosts don't see each other's folders.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    # With its scheme, so that callers can tell a local folder.
    return context.getCheckpointDir()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """One session setting for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
