"""Pairs of points within a distance, without a theta join.

The globe is cut into latitude bands as high as the radius; each band into columns at least as wide as the radius at its
poleward edge, so high latitudes need no special neighbours. Each point of the right side is sent to its own cell and to
the neighbours that lie ahead (next column, next band); the left side stays in its cell. Each pair thus meets once, and
the exact great-circle distance decides.

A cell that holds many points is joined in pieces by Spark's skew join (sort-merge is hinted, so that it applies).
Defined results: rows with null id or without a possible position are in no pair; longitudes match modulo 360; an id with
several rows counts at the position of the latest (`version`), or at the smallest position without one; no pair of an id
with itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.geo import EARTH_RADIUS_M, band_columns, cell_rows, haversine_m, possible_position, wrap_lon

#: Bands of fewer columns than this, next to the poles, count as one cell.
POLAR = 32


def positions(points: DataFrame, id_col: str, lat: str, lon: str, version: str | None = None) -> DataFrame:
    """(id, lat, lon): one possible position for each id, longitude in [-180, 180)."""
    p = points.select(F.col(id_col).cast("string").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), (F.col(version) if version else F.lit(0)).alias("v"))
    p = p.where(F.col("id").isNotNull() & possible_position(F.col("lat"), F.col("lon"), 360.0))
    p = p.groupBy("id").agg(F.max(F.struct("v", -F.col("lat"), -wrap_lon(F.col("lon")))).alias("s")).select("id", "s.*")
    return p.toDF("id", "v", "lat", "lon").select("id", (-F.col("lat")).alias("lat"), (-F.col("lon")).alias("lon"))


def _columns(band: Column, rows: float) -> Column:
    n = band_columns(band, rows)
    return F.when(n < POLAR, F.lit(1).cast("bigint")).otherwise(n)


def _column(lon: Column, n: Column) -> Column:
    return F.least(F.floor((lon + 180.0) / 360.0 * n).cast("bigint"), n - 1)


def with_cell(p: DataFrame, radius_m: float) -> DataFrame:
    """p with band, cell: the cell that holds each row's lat, lon."""
    rows = cell_rows(radius_m) * 1.01
    return p.withColumn("band", F.floor(F.col("lat") / rows).cast("bigint")).withColumn("cell", _column(F.col("lon"), _columns(F.col("band"), rows)))


def _reach(band: Column, lat: Column, lon: Column, rows: float, angle: float) -> Column:
    """Columns of a band that points within the angle of (lat, lon) may lie in."""
    n = _columns(band, rows)
    turn = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians(lat))))) * 1.0001
    low = F.floor((lon - turn + 180.0) / 360.0 * n).cast("bigint")
    high = F.floor((lon + turn + 180.0) / 360.0 * n).cast("bigint")
    high = F.least(high, low + n - 1)
    return F.when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(low, high), lambda c: F.pmod(c, n)))


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(id_a, id_b, distance_m): pairs of points (id, lat, lon) closer than radius_m, once each, id_a < id_b."""
    rows, angle = cell_rows(radius_m) * 1.01, radius_m / EARTH_RADIUS_M
    a = with_cell(points.select("id", "lat", "lon"), radius_m)
    nxt = F.pmod(F.col("cell") + 1, _columns(F.col("band"), rows))
    up = F.transform(_reach(F.col("band") + 1, F.col("lat"), F.col("lon"), rows, angle), lambda c: F.struct((F.col("band") + 1).alias("band"), c.alias("cell")))
    own = F.array(F.struct("band", "cell"))
    side = F.when(nxt != F.col("cell"), F.array(F.struct(F.col("band"), nxt.alias("cell")))).otherwise(F.slice(own, 1, 0))
    b = a.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("band").alias("band2"), F.col("cell").alias("cell2"), F.explode(F.array_distinct(F.concat(own, side, up))).alias("at"))
    b = b.select("id2", "lat2", "lon2", "band2", "cell2", "at.band", "at.cell")
    home = (F.col("band") == F.col("band2")) & (F.col("cell") == F.col("cell2"))
    met = a.hint("merge").join(b, ["band", "cell"]).where(~home | (F.col("id") < F.col("id2")))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return met.withColumn("distance_m", d).where(F.col("distance_m") < radius_m).select(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b"), "distance_m")


def distance_join(left: DataFrame, right: DataFrame, radius_m: float, inclusive: bool = True, on: tuple[str, ...] = ()) -> DataFrame:
    """All columns of left and right (prefixed r_ where the names clash) plus distance_m, for rows within radius_m.

    Both sides have lat, lon (possible positions, longitudes in [-180, 180)). The right side, which should be the
    smaller, is sent to the neighbouring cells. Both sides must also agree in the columns `on`.
    """
    rows, angle = cell_rows(radius_m) * 1.01, radius_m / EARTH_RADIUS_M * 1.0001
    right = right.select(*[F.col(c).alias(f"r_{c}" if c in left.columns and c not in on else c) for c in right.columns])
    a = with_cell(left, radius_m)
    rlat, rlon = (F.col("r_lat"), F.col("r_lon"))
    home = F.floor(rlat / rows).cast("bigint")

    def in_band(k: int) -> Column:
        return F.transform(_reach(home + k, rlat, rlon, rows, angle), lambda c: F.struct((home + k).alias("band"), c.alias("cell")))

    cells = F.flatten(F.array(in_band(-1), in_band(0), in_band(1)))
    b = right.withColumn("__at", F.explode(F.array_distinct(cells))).select("*", "__at.band", "__at.cell").drop("__at")
    d = haversine_m(F.col("lat"), F.col("lon"), rlat, rlon)
    met = a.join(b, ["band", "cell", *on]).drop("band", "cell").withColumn("distance_m", d)
    return met.where(F.col("distance_m") <= radius_m if inclusive else F.col("distance_m") < radius_m)
