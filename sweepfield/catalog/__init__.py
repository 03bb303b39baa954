"""Named queries over the driver tables and the SQL each is checked against."""

from importlib import import_module

FAMILIES = [
    "sweeps", "curves", "objectives", "trials", "contours", "validation", "primitives",
    "edits", "fits", "segments", "colors", "text", "boxes",
]


def _load():
    from sweepfield.catalog import registry

    from importlib.util import find_spec
    for family in FAMILIES:
        if find_spec(f"sweepfield.catalog.{family}"):
            import_module(f"sweepfield.catalog.{family}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
