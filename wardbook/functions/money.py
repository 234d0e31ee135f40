"""Exact money aggregation.

A SUM over DECIMAL(10,2) widens to DECIMAL(20,2), whose aggregation buffer
takes Spark's slow big-decimal path. Money has a fixed scale, so the same
exact sum is the BIGINT sum of the unscaled cents, turned back into a
decimal once per group. Under ANSI mode (Spark's default) a BIGINT overflow
raises an error instead of wrapping, so the result is exact or a failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SCALE = 2


def cents(x: Column) -> Column:
    """An amount as its BIGINT number of cents. A wider scale, or a double, is
    rounded to cents first, half cents away from zero."""
    return (x.cast(f"decimal(18,{MONEY_SCALE})") * F.lit(10 ** MONEY_SCALE)).cast("long")


def from_cents(c: Column, precision: int = 20) -> Column:
    """BIGINT cents back to DECIMAL(precision, 2)."""
    return (c.cast(f"decimal({precision},0)")
            * F.lit("0.01").cast("decimal(3,2)")).cast(f"decimal({precision},{MONEY_SCALE})")


def money_sum(x: Column) -> Column:
    """Exact SUM of a scale-2 decimal column, as DECIMAL(20,2) (NULL for no rows)."""
    return from_cents(F.sum(cents(x)))


def cents_sum(x: Column) -> Column:
    """Partial-aggregation friendly form: SUM of cents as BIGINT (combine with
    ``F.sum`` again, convert with ``from_cents`` at the end)."""
    return F.sum(cents(x))
