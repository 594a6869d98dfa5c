"""Environmental feature layers: neighbourhoods within a radius, slopes on grids, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.proximity import distance_join


def radius_aggregate(cells: DataFrame, radius_m: float, aggregates: list[Column]) -> DataFrame:
    """(lat_bin, lon_bin, aggregates over r_v): for each cell (lat, lon, v) the values of all cells within the radius."""
    near = distance_join(cells.select("lat_bin", "lon_bin", "lat", "lon"), cells.select("lat", "lon", F.col("v").alias("r_v")), radius_m)
    return near.groupBy("lat_bin", "lon_bin").agg(*aggregates)


def slopes(grid: DataFrame, value: str, reach: int = 3) -> DataFrame:
    """grid (lat_bin, lon_bin, value) with the largest mean absolute change for a cell over 1 to `reach` cells along rows and columns.

    Neighbours are looked up by index, so gaps in the grid give nulls, not wrong neighbours.
    """
    by_lon = Window.partitionBy("lat_bin").orderBy("lon_bin")
    by_lat = Window.partitionBy("lon_bin").orderBy("lat_bin")
    terms = []
    for w, axis in ((by_lon, "lon_bin"), (by_lat, "lat_bin")):
        for k in range(1, reach + 1):
            near = w.rangeBetween(k, k)
            terms.append(F.abs(F.max(value).over(near) - F.col(value)) / k)
    return grid.withColumn("slope", F.greatest(*terms))


def bilinear_resample(grid: DataFrame, points: DataFrame, value: str, n: int) -> DataFrame:
    """points (id, lat, lon) with the value of a grid (cells n to a degree, at their lower corners) interpolated between four corners; null unless all four are known.

    A point becomes its four corners with their shares: one join, one aggregation.
    """
    y, x = F.col("lat") * n, F.col("lon") * n
    y0, x0 = F.floor(y).cast("bigint"), F.floor(x).cast("bigint")
    fy, fx = y - y0, x - x0
    corner = lambda dy, dx, s: F.struct((y0 + dy).alias("lat_bin"), (x0 + dx).alias("lon_bin"), s.alias("share"))
    four = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(1, 0, fy * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 1, fy * fx))
    spread = points.select("id", F.inline(four)).join(grid.select("lat_bin", "lon_bin", F.col(value).alias("v")), ["lat_bin", "lon_bin"], "left")
    g = spread.groupBy("id").agg(F.sum(F.col("v") * F.col("share")).alias("s"), F.count("v").alias("k"))
    return g.select("id", F.when(F.col("k") == 4, F.col("s")).alias(value))
