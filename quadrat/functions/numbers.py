"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_one_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(1.0))


def finite(c: Column) -> Column:
    """NaN, infinities and null as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def percent_change(now: Column, before: Column) -> Column:
    """Null or a zero base give 0."""
    return F.coalesce(F.try_divide((now - before) * 100.0, before), F.lit(0.0))
