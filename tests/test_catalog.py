"""Registered queries against their SQL on the smallest data set.

A few queries of each family run by default; set ALL_QUERIES=1 for all.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

DATA = "/root/testdata/sf0.001"
CHOSEN = [
    "curve_metrics", "simulation_summary", "weighted_objective", "extract_targets", "best_so_far", "distinct_in_order",
    "self_intersections_touch", "minimum_gap", "validate_loops", "connect_port", "affine", "fit_errors", "split_min_points",
    "label_colors", "reply_dict", "reading_order", "read_sweeps", "primitive_inventory", "append_trials",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def names():
    every = list(entry.oracle_sql())
    return every if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
