"""Expressions whose result differs between SQL dialects, defined once: rounding casts, null-strict extremes, calendar differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bq_int(c: Column) -> Column:
    """Double to BIGINT, half away from zero."""
    return F.round(c).cast("bigint")


def _strict(f, cols: tuple[Column, ...]) -> Column:
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, f(*cols))


def strict_greatest(*cols: Column) -> Column:
    """Null if any argument is null."""
    return _strict(F.greatest, cols)


def strict_least(*cols: Column) -> Column:
    """Null if any argument is null."""
    return _strict(F.least, cols)


def safe_div(a: Column, b: Column) -> Column:
    """Null for a zero or null divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def month_diff(a: Column, b: Column) -> Column:
    """Month boundaries from a to b."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")


def whole_days(a: Column, b: Column) -> Column:
    """Complete days of 24 hours from timestamp a to b, towards zero."""
    s = (F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000
    return F.when(s < 0, F.ceil(s)).otherwise(F.floor(s)).cast("bigint")


def seconds_between(a: Column, b: Column) -> Column:
    """Complete seconds from timestamp a to b, towards zero."""
    s = (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000
    return F.when(s < 0, F.ceil(s)).otherwise(F.floor(s)).cast("bigint")
