import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from sweepfield.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def as_set(df, digits=9):
    """Rows as a set with floats rounded, columns in name order."""
    names = sorted(df.columns)
    fix = lambda v: round(v, digits) + 0.0 if isinstance(v, float) else v
    rows = [tuple(fix(r[n]) for n in names) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)
