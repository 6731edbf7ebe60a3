"""Rounding and defaults as the domain's client applications do them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + 0.5)


def tenth(x: Column) -> Column:
    return js_round(x * 10) / 10


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    """a / b, and the default (null if none) where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def or_one(x: Column) -> Column:
    """x, or 1 where x is null or 0."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, 1).otherwise(x)
