"""Areas left out of activity statistics, as boxes of longitude and latitude."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (min_lon, min_lat, max_lon, max_lat); where min_lon > max_lon the box crosses the date line.
ICE_BOXES = [
    (-120.0, 50.5, -46.8, 80.5),
    (39.5, 65.0, -46.8, 90.0),
    (15.95, 59.02, 36.23, 66.57),
    (-173.7, 62.0, -158.4, 66.8),
    (130.5, 50.6, -174.2, 67.8),
    (3.5, 78.1, 31.9, 85.0),
    (-179.8, 57.4, -156.5, 62.2),
    (-44.82, -57.93, -29.05, -50.61),
    (31.4, 61.4, 60.3, 73.1),
    (-27.61, 68.0, -19.47, 68.62),
]
MESSY_BOXES = [
    (-87.98, -57.8, -52.54, -35.05),
    (-45.38, -58.03, -27.77, -50.4),
    (136.9, -46.1, 151.4, -33.7),
    (-8.3, 60.6, 16.0, 71.5),
    (-4.96, 65.96, 30.0, 90.0),
    (-118.2, 50.8, -48.6, 90.0),
    (-178.0, 65.2, -110.9, 90.0),
    (33.3, 62.4, 179.1, 90.0),
    (-72.4642, 8.8698, -70.633, 10.6517),
]


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float], edges: bool = False) -> Column:
    w, s, e, n = box
    if edges:
        return lat.between(s, n) & lon.between(w, e)
    across = (lon > w) | (lon < e) if w > e else (lon > w) & (lon < e)
    return across & (lat > s) & (lat < n)


def in_boxes(lon: Column, lat: Column, boxes: list[tuple[float, float, float, float]], edges: bool = False) -> Column:
    """True where a point lies in any box; with edges, on its edge too."""
    return reduce(lambda a, b: a | b, [in_box(lon, lat, b, edges) for b in boxes])


def free_of_ice(lon: Column, lat: Column) -> Column:
    return ~in_boxes(lon, lat, ICE_BOXES)


def free_of_mess(lon: Column, lat: Column) -> Column:
    return ~in_boxes(lon, lat, MESSY_BOXES, edges=True)


def within_extent(lon: Column, lat: Column, box: tuple[float, float, float, float], buffer_deg: float = 0.0) -> Column:
    w, s, e, n = box
    return in_box(lon, lat, (w - buffer_deg, s - buffer_deg, e + buffer_deg, n + buffer_deg), edges=True)
