"""Folds over the arrays of one row whose cost stays near linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Items of one inner fold.
BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often or deep inside lambdas it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_collect(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], collected: str) -> Column:
    """What a fold over ``items`` emits, in order, as an array of type ``collected``.

    ``step(state, item)`` gives the next state and an array of what the item
    adds. A plain fold copies all that was emitted at every item. Here each
    block of items fills its own list, and the outer fold carries the state on
    and gathers the lists, so an item costs at most half a block of copies.
    Null items give null.
    """
    none = F.array().cast(collected)
    lists = F.array().cast(f"array<{collected}>")

    def inner(state: Column, block: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            after, added = step(acc["state"], item)
            return F.struct(after.alias("state"), F.concat(acc["found"], added).alias("found"))

        return F.aggregate(block, F.struct(state.alias("state"), none.alias("found")), one)

    def outer(acc: Column, block: Column) -> Column:
        return bound(inner(acc["state"], block), lambda r: F.struct(
            r["state"].alias("state"), F.concat(acc["lists"], F.array(r["found"])).alias("lists")))

    def fold(all_items: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_items) - 1) / BLOCK), F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_items, i * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, F.struct(start.alias("state"), lists.alias("lists")), outer, lambda acc: F.flatten(acc["lists"]))

    return bound(items, fold)
