"""Ordered windows that stay spread out when one group holds much of the table.

A plain window puts a whole group into one task. ``measure_spans`` looks for
the groups that are too large for that, any number of them, and the functions
below cut just those groups into consecutive spans of their order column, with
borders at quantiles, so crowded stretches are cut finer. Each span is
processed on its own; what crosses a span border (the neighbouring row, the
running total so far) comes from a small table with one row per span.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweepfield.plans.sizing import broadcast_if_small
from sweepfield.session import shared_folder

SPAN = "_span"
ROWS_PER_SPAN = 1_000_000
# Quantiles taken in one pass; groups that need more are cut again, span by span.
FAN = 1_024
# Steps of the binary search over a group's borders: 2^20 spans at most.
_STEPS = [1 << k for k in range(20, -1, -1)]


@dataclass(frozen=True)
class Spans:
    """Groups to split, as a table of ``keys`` and their sorted ``_cuts``. Without a table every group fits into one task."""

    keys: tuple[str, ...] = ()
    order: str | None = None
    borders: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.borders is not None

    def cut(self, df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Add the span number of every row; rows of other groups are in span 0.

        Any monotone numbering along ``order`` is right, so spans also serve
        finer groups (more keys behind their own). Other keys are refused.
        """
        if list(self.keys) != list(keys[: len(self.keys)]):
            raise ValueError(f"spans of {list(self.keys)} can't cut groups of {keys}")
        names = [f"_b{i}" for i in range(len(self.keys))]
        marks = self.borders.select(*[F.col(k).alias(n) for k, n in zip(self.keys, names)], "_cuts")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(self.keys, names)])
        found = df.join(broadcast_if_small(marks), on, "left")
        return found.select(*df.columns, F.coalesce(_borders_before("_cuts", order_value(order)), F.lit(0)).cast("long").alias(SPAN))


NO_SPLIT = Spans()


def _borders_before(cuts: str, place: Column) -> Column:
    """How many of the sorted borders lie at or below the place, by binary search."""

    def narrow(at: Column, step: Column) -> Column:
        ahead = at + step
        inside = ahead <= F.size(cuts)
        return F.when(inside & (F.get(F.col(cuts), ahead - 1) <= place), ahead).otherwise(at)

    return F.when(F.col(cuts).isNotNull(), F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), narrow))


def order_value(order: str) -> Column:
    """Order column as a double; timestamps count in seconds."""
    return F.col(order).cast("double")


def measure_spans(
    df: DataFrame, keys: list[str], order: str, rows_per_span: int = ROWS_PER_SPAN
) -> Spans:
    """Find the groups above ``rows_per_span`` rows and the borders that cut them.

    One aggregate with map-side combine finds the groups. Their borders are
    quantiles of the order column; spans that still hold too many rows are cut
    again by themselves until only rows of equal order stay together. Nothing
    but the largest count reaches the driver.
    """
    place = order_value(order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_span)
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return Spans(tuple(keys), order)
    shared_folder(df.sparkSession)
    large = sizes.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)])
    rows = df.join(broadcast_if_small(large), on, "left_semi").select(*keys, place.alias("_place"))
    borders = _quantiles(rows, keys, most, rows_per_span).checkpoint()
    while most > FAN * rows_per_span:
        # Very large groups: cut the spans that are still too large.
        pieces = Spans(tuple(keys), "_place", borders).cut(rows, keys, "_place")
        inner = pieces.groupBy(*keys, SPAN).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
        wide = inner.filter((F.col("_n") > 2 * rows_per_span) & (F.col("_lo") < F.col("_hi"))).select(
            *[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], F.col(SPAN).alias("_s"), "_n").checkpoint()
        most = wide.agg(F.max("_n")).first()[0]
        if most is None:
            break
        again = pieces.join(broadcast_if_small(wide.drop("_n")), on & (F.col(SPAN) == F.col("_s")), "left_semi")
        finer = _quantiles(again, [*keys, SPAN], most, rows_per_span).select(*keys, "_cuts")
        borders = borders.unionByName(finer).groupBy(*keys).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_cuts")))).alias("_cuts")).checkpoint()
    return Spans(tuple(keys), order, borders)


def _quantiles(rows: DataFrame, keys: list[str], most: int, rows_per_span: int) -> DataFrame:
    """Sorted distinct borders of every group; the lowest place is never one."""
    count = min(FAN, -(-most // rows_per_span))
    cuts = F.percentile_approx("_place", [k / count for k in range(1, count)] or [0.5], max(10_000, 20 * count))
    found = rows.groupBy(*keys).agg(cuts.alias("_q"), F.min("_place").alias("_low"))
    return found.select(*keys, F.array_sort(F.array_distinct(F.filter("_q", lambda q: q > F.col("_low")))).alias("_cuts"))


def ensure_spans(df: DataFrame, keys: list[str], order: str, spans: Spans | None) -> Spans:
    """Caller's spans, or a fresh measurement when none were given or theirs belong to other keys."""
    if spans is not None and (not spans.keys or list(spans.keys) == list(keys[: len(spans.keys)])):
        return spans
    return measure_spans(df, keys, order)


def _on(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _attach(rows: DataFrame, small: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Join per-span columns onto the rows, null keys included."""
    kept = [F.col(f"_r.{c}") for c in rows.columns]
    return rows.alias("_r").join(small.alias("_s"), _on(keys, "_r", "_s"), "left").select(
        *kept, *[F.col(f"_s.{c}") for c in extra]
    )


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    spans: Spans,
    prev: str | None = "prev",
    next: str | None = "next",
    cyclic: bool = False,
) -> DataFrame:
    """Add structs of ``fields`` from the row before and after within the group.

    The structs are null at the group's ends, or wrap around when ``cyclic``.
    """
    record = F.struct(*[F.col(f) for f in fields])
    if not spans:
        window = Window.partitionBy(*keys).orderBy(*order)
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, after = F.lag(record).over(window), F.lead(record).over(window)
        if cyclic:
            before = F.coalesce(before, F.last(record).over(whole))
            after = F.coalesce(after, F.first(record).over(whole))
        added = ([before.alias(prev)] if prev else []) + ([after.alias(next)] if next else [])
        return df.select("*", *added)

    cut = spans.cut(df, keys, order[0])
    inner = keys + [SPAN]
    window = Window.partitionBy(*inner).orderBy(*order)
    rows = cut.select("*", F.lag(record).over(window).alias("_lag"), F.lead(record).over(window).alias("_lead"))
    place = F.struct(*[F.col(o) for o in order])
    ends = cut.groupBy(*inner).agg(
        F.min_by(record, place).alias("_head"), F.max_by(record, place).alias("_tail")
    )
    # One row per span.
    along = Window.partitionBy(*keys).orderBy(SPAN)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag("_tail").over(along), F.lead("_head").over(along)
    if cyclic:
        before = F.coalesce(before, F.last("_tail").over(whole))
        after = F.coalesce(after, F.first("_head").over(whole))
    borders = ends.select(*inner, before.alias("_before"), after.alias("_after"))
    joined = _attach(rows, borders, inner, ["_before", "_after"])
    added = []
    if prev:
        added.append(F.coalesce("_lag", "_before").alias(prev))
    if next:
        added.append(F.coalesce("_lead", "_after").alias(next))
    return joined.select(*df.columns, *added)


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    spans: Spans,
    reverse: bool = False,
) -> DataFrame:
    """Add running ``sum``, ``min`` or ``max`` columns from the group's start to the row.

    With ``reverse`` they run from the group's end back to the row.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    along = [F.desc(o) if reverse else F.asc(o) for o in order]
    if not spans:
        window = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fold[kind](value).over(window).alias(name) for name, (kind, value) in totals.items()])

    cut = spans.cut(df, keys, order[0])
    inner = keys + [SPAN]
    window = Window.partitionBy(*inner).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.select(
        "*", *[fold[kind](value).over(window).alias(f"_in_{name}") for name, (kind, value) in totals.items()]
    )
    sums = cut.groupBy(*inner).agg(
        *[fold[kind](value).alias(f"_all_{name}") for name, (kind, value) in totals.items()]
    )
    passed = F.desc(SPAN) if reverse else F.asc(SPAN)
    earlier = Window.partitionBy(*keys).orderBy(passed).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *inner, *[fold[kind](F.col(f"_all_{name}")).over(earlier).alias(f"_to_{name}") for name, (kind, _) in totals.items()]
    )
    joined = _attach(rows, carried, inner, [f"_to_{name}" for name in totals])
    merged = []
    for name, (kind, _) in totals.items():
        carry, own = F.col(f"_to_{name}"), F.col(f"_in_{name}")
        if kind == "sum":
            both = F.coalesce(carry + own, carry, own)
        else:
            both = F.least(carry, own) if kind == "min" else F.greatest(carry, own)
        merged.append(both.alias(name))
    return joined.select(*df.columns, *merged)


def with_position(df: DataFrame, keys: list[str], order: list[str], spans: Spans, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row within its group."""
    return with_running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, spans)


def with_group(df: DataFrame, keys: list[str], aggregates: dict[str, Column], spans: Spans) -> DataFrame:
    """Add whole-group aggregates to every row.

    Small groups use an unordered window (one shuffle). Split groups are
    aggregated with map-side combine and joined back.
    """
    if not spans:
        window = Window.partitionBy(*keys)
        return df.select("*", *[value.over(window).alias(name) for name, value in aggregates.items()])
    small = df.groupBy(*keys).agg(*[value.alias(name) for name, value in aggregates.items()])
    return _attach(df, small, keys, list(aggregates))


def with_islands(
    df: DataFrame, keys: list[str], order: list[str], starts: Column, spans: Spans, name: str = "island"
) -> DataFrame:
    """Number the runs of consecutive rows; ``starts`` is true on the first row of a run."""
    return with_running(
        df, keys, order, {name: ("sum", F.when(starts, 1).otherwise(0).cast("long"))}, spans
    )
