"""Order-dependent folds over groups of any size, block by block.

Some rules walk through a group in order and carry a little state along. A
group is cut into blocks that are folded side by side. At first each block
starts from nothing; what a block leaves is what the next one should have
started from, and blocks that started from something else are folded again,
until none did. Walks from different starts mostly fall into step at the next
natural border, so a round or two is enough; at worst each round settles one
more block, with a block's rows in memory and never a group's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepfield.plans.folds import Columns, fold_groups
from sweepfield.plans.ordered import Spans, with_position
from sweepfield.session import shared_folder

BLOCK = 20_000  # rows that one task folds in order


def in_blocks(df: DataFrame, keys: list[str], order: list[str], spans: Spans, size: int | None = None) -> DataFrame:
    """Add ``block``, the number of each row's stretch of ``size`` rows within its group."""
    placed = with_position(df, keys, order, spans, "_at")
    return placed.withColumn("block", F.floor((F.col("_at") - 1) / (size or BLOCK))).drop("_at")


def fold_in_blocks(
    rows: DataFrame, keys: list[str], order: list[str], leave: Callable[[Columns], Columns], close: Callable[[Columns], Columns | None],
    state: dict[str, tuple[str, object]], schema: str,
) -> DataFrame:
    """Fold ``rows`` with a ``block`` column in order.

    ``state`` names the carried columns with their types and first values; a
    block's group holds them as columns. ``leave`` returns the state after the
    block as a row of arrays with one value, ``close`` the block's output; its
    group also has ``last``, whether the block is the group's last.
    """
    shared_folder(rows.sparkSession)
    places, names = [*keys, "block"], list(state)
    first = [F.lit(value).cast(kind).alias(name) for name, (kind, value) in state.items()]
    alone = lambda df: df.select("*", *first, F.lit(True).alias("last"))
    several = rows.filter("block > 0").select(*keys).distinct().checkpoint()
    if several.isEmpty():
        return fold_groups(alone(rows), places, order, close, schema)
    long = rows.join(several, keys, "left_semi").checkpoint()
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    left_schema = ", ".join([*[f"{p} {kind[p]}" for p in places], *[f"{n} {k}" for n, (k, _) in state.items()]])

    def left(starts: DataFrame) -> DataFrame:
        def fold(group: Columns) -> Columns:
            return {p: group[p][:1] for p in places} | leave(group)

        return fold_groups(long.join(starts, places), places, order, fold, left_schema).checkpoint()

    starts = long.select(*places).distinct().select(*places, *first).checkpoint()
    ends = left(starts)
    while True:
        due = ends.select(*keys, (F.col("block") + 1).alias("block"), *[F.col(n).alias(f"_{n}") for n in names])
        alike = F.lit(True)
        for name in names:
            alike = alike & F.col(name).eqNullSafe(F.col(f"_{name}"))
        wrong = starts.join(due, places).filter(~alike).select(*places, *[F.col(f"_{n}").alias(n) for n in names]).checkpoint()
        if wrong.isEmpty():
            break
        starts = starts.join(wrong, places, "left_anti").unionByName(wrong).checkpoint()
        ends = ends.join(wrong, places, "left_anti").unionByName(left(wrong)).checkpoint()
    final = starts.join(long.groupBy(*keys).agg(F.max("block").alias("_last")), keys).withColumn("last", F.col("block") == F.col("_last")).drop("_last")
    both = alone(rows.join(several, keys, "left_anti")).unionByName(long.join(final, places))
    return fold_groups(both, places, order, close, schema)
