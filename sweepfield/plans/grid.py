"""Grids that turn geometric nearness into equi-joins.

A hot entity spreads over many cells and so over many join keys. Entities with
few rows use a single cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many rows an entity is joined with itself in one cell.
SMALL = 64


def around(cells: DataFrame, names: tuple[str, str] = ("cell_x", "cell_y"), half: bool = False) -> DataFrame:
    """Repeat each row for the 3×3 cells around its own (or five of them, for unordered pairs)."""
    offsets = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    if not half:
        offsets += [(-a, -b) for a, b in offsets[1:]]
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    spread = cells.select("*", F.explode(shifts).alias("_shift"))
    kept = [c for c in cells.columns if c not in names]
    return spread.select(
        *kept,
        (F.col(names[0]) + F.col("_shift.a")).alias(names[0]),
        (F.col(names[1]) + F.col("_shift.b")).alias(names[1]),
        ((F.col("_shift.a") == 0) & (F.col("_shift.b") == 0)).alias("_home"),
    )
