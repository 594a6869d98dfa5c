"""Geographic expressions. Every function takes and returns Columns and stays inside code generation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def possible_position(lat: Column, lon: Column, lon_max: float = 180.0) -> Column:
    """True where both are finite degrees: |lat| <= 90, -180 <= lon <= lon_max. Never null."""
    ok = (F.abs(lat) <= 90) & (lon >= -180) & (lon <= lon_max) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def wrap_lon(lon: Column) -> Column:
    """Longitude moved into [-180, 180), any number of turns."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float = EARTH_RADIUS_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius_m * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_np(lat1, lon1, lat2, lon2, radius_m: float = EARTH_RADIUS_M):
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * radius_m * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def grid_index(deg: Column, n: int) -> Column:
    """Index of the cell of 1/n degree that holds deg."""
    return F.floor(deg * n).cast("bigint")


def cell_rows(radius_m: float) -> float:
    """Height in degrees of latitude of the square cells used for a radius."""
    return math.degrees(radius_m / EARTH_RADIUS_M)


def band_columns(band: Column, rows: float) -> Column:
    """Cells around the globe in one latitude band of `rows` degrees: each at least as wide as high at the band's poleward edge."""
    edge = F.greatest(F.abs(band * rows), F.abs((band + 1) * rows))
    return F.greatest(F.floor(360.0 / rows * F.cos(F.radians(F.least(F.lit(90.0), edge)))).cast("bigint"), F.lit(1).cast("bigint"))


def dead_reckon(lat: Column, lon: Column, course: Column, knots: Column, minutes: Column) -> tuple[Column, Column]:
    """Position after `minutes` (negative: before) at a constant course and speed, on a local plane (1 degree of latitude = 60 nm)."""
    nm = knots * minutes / 60.0
    return (
        lat + nm * F.cos(F.radians(course)) / 60.0,
        lon + nm * F.sin(F.radians(course)) / (60.0 * F.cos(F.radians(lat))),
    )


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle course from 1 to 2 in [0, 360)."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def planar_course_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Course on a local plane, longitude shrunk by the cosine of the first latitude."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1)), F.lit(360.0))


#: The radii in km along and across the axis that satellite speeds are computed with.
RADIUS_EQUATOR_KM, RADIUS_POLE_KM = 6371.001, 6356.752


def earth_radius_km(lat: Column) -> Column:
    """Radius of the ellipsoid at a latitude."""
    a, b = RADIUS_EQUATOR_KM, RADIUS_POLE_KM
    c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
    top = F.pow(a * a * c, 2) + F.pow(b * b * s, 2)
    return F.sqrt(top / (F.pow(a * c, 2) + F.pow(b * s, 2)))


def segment_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance from a point to the segment 1-2 on a plane around the point."""
    k = math.radians(1) * EARTH_RADIUS_M
    shrink = F.cos(F.radians(lat))
    x1, y1, x2, y2 = (lon1 - lon) * k * shrink, (lat1 - lat) * k, (lon2 - lon) * k * shrink, (lat2 - lat) * k
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide(-(x1 * dx + y1 * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(x1 + t * dx, 2) + F.pow(y1 + t * dy, 2))


def mean_lon(lon1: Column, lon2: Column, w1: Column, w2: Column) -> Column:
    """Weighted mean of two longitudes the short way round, in [-180, 180]."""
    far = F.abs(lon1 - lon2) > 180
    a, b = F.when(far & (lon1 < 0), lon1 + 360).otherwise(lon1), F.when(far & (lon2 < 0), lon2 + 360).otherwise(lon2)
    return near_lon(F.try_divide(a * w1 + b * w2, w1 + w2))


def near_lon(lon: Column) -> Column:
    """Longitude brought back by one turn where it is past +-180."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def cell_area_km2(lat: Column, n: int, degree_km: float = 111.0) -> Column:
    """Area of a cell of 1/n degree at a latitude."""
    return F.lit(degree_km * degree_km / (n * n)) * F.cos(F.radians(lat))


def bilinear(q11: Column, q12: Column, q21: Column, q22: Column, x1: Column, x2: Column, y1: Column, y2: Column, x: Column, y: Column) -> Column:
    """Value at (x, y) from the corners q11 (x1, y1), q12 (x1, y2), q21 (x2, y1), q22 (x2, y2); a degenerate side counts as its lower corner."""
    fx = F.when(x2 == x1, F.lit(0.0)).otherwise(F.try_divide(x - x1, x2 - x1))
    fy = F.when(y2 == y1, F.lit(0.0)).otherwise(F.try_divide(y - y1, y2 - y1))
    return q11 * (1 - fx) * (1 - fy) + q21 * fx * (1 - fy) + q12 * (1 - fx) * fy + q22 * fx * fy


def doppler_offset_nm(speed_knots: Column, course: Column, sat_course: Column, sat_knots: Column, slant_nm: Column) -> Column:
    """Along-track displacement of a moving target: its speed towards the radar over the satellite's, times the slant range."""
    across = speed_knots * F.sin(F.radians(course - sat_course))
    return F.try_divide(across * slant_nm, sat_knots)


def look_angle_deg(ground_m: Column, altitude_m: Column, descending: Column) -> Column:
    """Angle off nadir; negative on descending passes."""
    return F.degrees(F.atan2(ground_m, altitude_m)) * F.when(descending, -1.0).otherwise(1.0)
