"""Order-independent sums of money columns.

Prices, rates and balances are doubles with two decimals. They are turned into whole hundredths and
added as integers, so a result does not depend on the order of the rows or on the number of tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT_BITS = 20


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hundredths(x: str | Column) -> Column:
    """Whole hundredths of a two-decimal double, as a long."""
    return F.floor(_c(x) * 100 + 0.5).cast("long")


def revenue_units() -> Column:
    """Discounted price of a line, in units of 1e-4."""
    return hundredths("l_extendedprice") * (F.lit(100) - hundredths("l_discount"))


def charge_units() -> Column:
    """Discounted price with tax, in units of 1e-6."""
    return revenue_units() * (F.lit(100) + hundredths("l_tax"))


def profit_units() -> Column:
    """Discounted price minus supply cost times quantity, in units of 1e-4."""
    return revenue_units() - hundredths("ps_supplycost") * hundredths("l_quantity")


def stock_units() -> Column:
    """Supply cost times available quantity, in units of 1e-2."""
    return hundredths("ps_supplycost") * F.col("ps_availqty").cast("long")


def exact_total(units: Column) -> Column:
    """Exact sum of long ``units`` as decimal(38,0).

    The high and low bits are added apart, so neither long accumulator overflows at any data size
    that fits a table, and the loop stays on primitive longs instead of big decimals.
    """
    high = F.sum(F.shiftright(units, _SPLIT_BITS)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _SPLIT_BITS) - 1))).cast("decimal(38,0)")
    return (high * F.lit(1 << _SPLIT_BITS) + low).cast("decimal(38,0)")


def exact_sum(units: Column, decimals: int) -> Column:
    """Exact sum of long ``units`` as a double, with ``decimals`` decimal places; null without rows."""
    return exact_total(units).cast("double") / F.lit(float(10 ** decimals))


def exact_avg(units: Column, decimals: int) -> Column:
    """Mean of long ``units``; null without rows."""
    return F.try_divide(exact_sum(units, decimals), F.count(units))
