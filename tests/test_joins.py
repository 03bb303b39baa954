"""Joins of derived tables are planned by measured sizes, never by those of the files."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
# Each joins rows that an explode or a split made of a small table.
DERIVED = [
    "circle_fit", "classify_segments", "line_fit_chord", "line_fit_pca", "mirror_symmetry", "merge_adjacent", "merge_greedy",
    "robustness_score", "validate_loops", "tangent_continuity",
]


@pytest.mark.parametrize("name", DERIVED)
def test_no_side_is_broadcast_by_its_estimate(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan or "Python" in plan or "MapInPandas" in plan
    assert "Broadcast" not in plan
