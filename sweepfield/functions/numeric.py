"""Small numeric column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(value: Column | str | float | int) -> Column:
    """A column from a name or an existing column; numbers become literals."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fixed_sequence(start: Column, stop: Column) -> Column:
    """Ascending integer sequence, empty when ``stop`` lies below ``start``."""
    return F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))


def stable_unit(*parts: Column | int) -> Column:
    """Repeatable pseudo-random number in [0, 1) from integer keys.

    Linear congruences in 64-bit arithmetic keep it identical on any engine.
    """
    state = F.lit(12345).cast("long")
    for part in parts:
        value = part if isinstance(part, Column) else F.lit(part)
        mixed = F.pmod(state + F.pmod(value.cast("long"), F.lit(2147483647)), F.lit(2147483647))
        state = F.pmod(mixed * F.lit(48271) + F.lit(11), F.lit(2147483647))
    return state / F.lit(2147483647.0)
