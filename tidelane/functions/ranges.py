"""Ranges of dates, windows and tiles that runs are split into."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def date_windows(start: dt.date, end: dt.date, days: int) -> list[tuple[dt.date, dt.date]]:
    """Consecutive [first, next) windows of `days`; the last ends at end."""
    out = []
    while start < end:
        out.append((start, min(end, start + dt.timedelta(days=days))))
        start += dt.timedelta(days=days)
    return out


def half_months(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """[1st, 16th) and [16th, next 1st) of every month that starts in [start, end)."""
    out, first = [], start.replace(day=1)
    while first < end:
        middle, nxt = first.replace(day=16), (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        out += [(first, middle), (middle, nxt)]
        first = nxt
    return out


def tile_grid(spark: SparkSession, west: int, south: int, east: int, north: int, step: int) -> DataFrame:
    """(min_lon, min_lat, max_lon, max_lat) of square tiles over a box in whole degrees."""
    x, y = F.explode(F.sequence(F.lit(west), F.lit(east - step), F.lit(step))), F.explode(F.sequence(F.lit(south), F.lit(north - step), F.lit(step)))
    g = spark.range(1).select(x.alias("min_lon")).select("min_lon", y.alias("min_lat"))
    return g.select(*[F.col(c).cast("bigint").alias(c) for c in ("min_lon", "min_lat")], (F.col("min_lon") + step).cast("bigint").alias("max_lon"), (F.col("min_lat") + step).cast("bigint").alias("max_lat"))
