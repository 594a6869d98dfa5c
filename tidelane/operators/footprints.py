"""Footprints as rasters, and areas where fast road traffic shows up displaced."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions import geo
from tidelane.operators.polygons import inside_rings
from tidelane.operators.trips import convex_hull


def rasterize(foot: DataFrame, n: int) -> DataFrame:
    """(scene_id, lat_index, lon_index, look_angle): cells (n to a degree) whose centre lies in a scene's box, with the angle to the satellite's track.

    foot: scene_id, lat0, lat1, lon0, lon1, sat_lat0, sat_lon0, sat_lat1, sat_lon1, altitude_m. Both index arrays are exploded in one row's scope; no join.
    """
    low, high = F.floor(F.col("lat0") * n).cast("bigint"), F.floor(F.col("lat1") * n).cast("bigint")
    left, right = F.floor(F.col("lon0") * n).cast("bigint"), F.floor(F.col("lon1") * n).cast("bigint")
    g = foot.withColumn("lat_index", F.explode(F.sequence(low, high))).withColumn("lon_index", F.explode(F.sequence(left, right)))
    lat, lon = (F.col("lat_index") + 0.5) / n, (F.col("lon_index") + 0.5) / n
    g = g.where(lat.between(F.col("lat0"), F.col("lat1")) & lon.between(F.col("lon0"), F.col("lon1")))
    ground = geo.segment_distance_m(lat, lon, F.col("sat_lat0"), F.col("sat_lon0"), F.col("sat_lat1"), F.col("sat_lon1"))
    return g.select("scene_id", "lat_index", "lon_index", geo.look_angle_deg(ground, F.col("altitude_m"), F.col("sat_lat1") < F.col("sat_lat0")).alias("look_angle"))


def road_points(roads: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(road_id, lat, lon, course) of road vertices (road_id, k, lat, lon): the course to the next vertex, the last one's from the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("road_id").orderBy("k")
    r = roads.withColumns({"la": F.lead("lat").over(w), "lo": F.lead("lon").over(w), "pa": F.lag("lat").over(w), "po": F.lag("lon").over(w)})
    ahead = geo.planar_course_deg(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
    back = geo.planar_course_deg(F.col("pa"), F.col("po"), F.col("lat"), F.col("lon"))
    return r.select("road_id", "lat", "lon", F.coalesce(ahead, back).alias("course"))


def displaced(points: DataFrame, sat_course: float, sat_knots: float, slant_nm: float, speed_knots: float) -> DataFrame:
    """(road_id, lat, lon): where traffic at a speed, in both directions, would appear, and the road itself."""
    c = np.radians(sat_course)
    out = []
    for sign in (-1.0, 0.0, 1.0):
        off = geo.doppler_offset_nm(F.lit(sign * speed_knots), F.col("course"), F.lit(sat_course), F.lit(sat_knots), F.lit(slant_nm))
        out.append(points.select("road_id", (F.col("lat") - off * float(np.cos(c)) / 60).alias("lat"), (F.col("lon") - off * float(np.sin(c)) / (60 * F.cos(F.radians("lat")))).alias("lon")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, corners): the convex hull of each group's points, as an array of (lon, lat).

    Hulls of parts are made first, so that a task holds corners, not all points of a group.
    """
    kind = points.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, lon double, lat double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[convex_hull(pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float))]

    parts = points.select(by, "lon", "lat").dropna().mapInPandas(lambda it: (pd.concat([corners(g) for _, g in pdf.groupby(by)]) for pdf in it if len(pdf)), schema)

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
        k = convex_hull(x, y)
        turn = np.argsort(np.arctan2(y[k] - y[k].mean(), x[k] - x[k].mean()))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "corners": [[{"lon": float(x[i]), "lat": float(y[i])} for i in k[turn]]]})

    return parts.groupBy(by).applyInPandas(hull, f"{by} {kind}, corners array<struct<lon:double,lat:double>>")


def in_hull(corners, lon, lat) -> np.ndarray:
    """Which points lie in one hull."""
    ring = np.array([(c["lon"], c["lat"]) for c in corners] + [(corners[0]["lon"], corners[0]["lat"])], float)
    return inside_rings([ring], np.asarray(lon, float), np.asarray(lat, float))
