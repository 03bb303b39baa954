"""Registry of named queries, each with its reference SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sweepfield.catalog import views
from sweepfield.session import MEASURED_JOINS, apply_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` may start from any view of ``views.SQL``."""

    def wrap(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark, MEASURED_JOINS)
            return function(views.Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(sql)
        return function

    return wrap
