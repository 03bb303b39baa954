"""Spark analytics for engineering design sweeps.

Every operator takes DataFrames and returns a DataFrame keyed by an entity
(design, run, contour, image, document), so one job covers all entities.
"""

from sweepfield.session import build_session

__all__ = ["build_session"]

# Functions that run in Python workers travel by value, so executors need no
# copy of this package.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
