"""Polygons without a geometry library: reading WKT, cutting areas into grid cells, and the areas that hold a point.

An area is cut once into cells of `cell_deg`. A cell wholly inside needs no test; a cell that an edge may cross carries
the edges of its latitude band, for even-odd ray casting on lon/lat. Points then meet areas through an equi-join on the
cell, never through a theta join. Edges are straight in lon/lat. Rings may run past 180 degrees or jump at the date
line; points match modulo 360.

Defined results: null, empty or unreadable WKT, rings of under four points or not closed, and latitudes past 90 give an
area that holds nothing; rows with a repeated id act as one area (their union); parts of one geometry act as a union;
points without a possible position are in no area.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.geo import possible_position
from tidelane.runtime import BROADCAST_ROWS, salted_join

CELLS = "area string, part int, row bigint, col bigint, turn double, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
_HEAD = re.compile(r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", re.I | re.S)


def read_wkt(text: str | None) -> list[list[np.ndarray]]:
    """Parts, each a list of closed rings (outer first) as (n, 2) lon/lat; [] where the text holds no readable polygon."""
    m = _HEAD.match(text or "")
    if not m:
        return []
    body = re.sub(r"\s+", " ", m.group(2))
    body = re.sub(r"\s*([(),])\s*", r"\1", body)
    if m.group(1).upper() == "POLYGON":
        body = f"({body})"
    if not re.fullmatch(r"\((?:\((?:\([^()]+\),?)+\),?)+\)", body) or "),)" in body or ")(" in body:
        return []
    parts = []
    for part in re.findall(r"\(((?:\([^()]+\),?)+)\)", body[1:-1]):
        rings: list[np.ndarray] = []
        for ring in re.findall(r"\(([^()]+)\)", part):
            try:
                points = np.array([[float(v) for v in p.split(" ")[:2]] for p in ring.split(",")], dtype=float)
            except ValueError:
                return []
            if points.ndim != 2 or points.shape[1] != 2 or len(points) < 4 or not np.isfinite(points).all() or (points[0] != points[-1]).any() or np.abs(points[:, 1]).max() > 90:
                return []
            jumps = np.round(np.diff(points[:, 0]) / 360.0)  # 179 to -179 goes on to 181
            points[1:, 0] -= 360.0 * np.cumsum(jumps)
            if rings:
                points[:, 0] += 360.0 * np.round((rings[0][:, 0].mean() - points[:, 0].mean()) / 360.0)
            rings.append(points)
        parts.append(rings)
    return parts


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    e = np.concatenate([np.column_stack([r[:-1], r[1:]]) for r in rings])
    return e[e[:, 1] != e[:, 3]]  # level edges never cross a level ray


def inside_rings(rings: list[np.ndarray], lon, lat) -> np.ndarray:
    """Even-odd test of points (arrays) against one part."""
    e, lon, lat = _edges(rings), np.atleast_1d(lon), np.atleast_1d(lat)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((e[:, 1] > lat[:, None]) != (e[:, 3] > lat[:, None])) & (lon[:, None] < (e[:, 2] - e[:, 0]) * (lat[:, None] - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
    return cross.sum(axis=1) % 2 == 1


def cut_part(rings: list[np.ndarray], cell_deg: float):
    """(row, col, turn, inside, edges or None) of each cell of one part; turn is added to a longitude in [0, 360)."""
    e, cols = _edges(rings), round(360.0 / cell_deg)
    if not len(e):
        return
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    c0, c1 = int(np.floor(left.min() / cell_deg)), int(np.floor(right.max() / cell_deg))
    for row in range(int(np.floor(low.min() / cell_deg)), int(np.floor(high.max() / cell_deg)) + 1):
        band = (high >= row * cell_deg) & (low <= (row + 1) * cell_deg)
        if not band.any():
            continue
        near = np.zeros(c1 - c0 + 3, int)  # cells that an edge's box touches
        np.add.at(near, np.floor(left[band] / cell_deg).astype(int) - c0, 1)
        np.add.at(near, np.floor(right[band] / cell_deg).astype(int) - c0 + 1, -1)
        crossed = np.cumsum(near)[: c1 - c0 + 1] > 0
        centre = (np.arange(c0, c1 + 1) + 0.5) * cell_deg
        held = inside_rings(rings, centre, np.full(len(centre), (row + 0.5) * cell_deg))
        for k in np.flatnonzero(crossed | held):
            col = c0 + int(k)
            yield row, col % cols, float(360.0 * (col // cols)), not crossed[k], e[band] if crossed[k] else None


def area_cells(areas: DataFrame, area_id: str, wkt: str, cell_deg: float = 0.25) -> DataFrame:
    """CELLS of every readable area."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for area, text in zip(pdf["area"], pdf["wkt"]):
                for k, rings in enumerate(read_wkt(text)):
                    for row, col, turn, held, e in cut_part(rings, cell_deg):
                        rows.append((area, k, row, col, turn, held, None if e is None else [{"x1": a, "y1": b, "x2": c, "y2": d} for a, b, c, d in e.tolist()]))
                        if len(rows) >= 2000:
                            yield pd.DataFrame(rows, columns=["area", "part", "row", "col", "turn", "inside", "edges"])
                            rows = []
            yield pd.DataFrame(rows, columns=["area", "part", "row", "col", "turn", "inside", "edges"])

    texts = areas.select(F.col(area_id).cast("string").alias("area"), F.col(wkt).cast("string").alias("wkt")).where("area is not null and wkt is not null").distinct()
    return texts.mapInPandas(cut, CELLS).withColumns({"row": F.col("row").cast("bigint"), "col": F.col("col").cast("bigint")})


def _odd_crossings(edges: Column, lon: Column, lat: Column) -> Column:
    hit = F.filter(edges, lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(hit) % 2 == 1


def areas_holding(points: DataFrame, areas: DataFrame, point_id: str, lat: str, lon: str, area_id: str, wkt: str, cell_deg: float = 0.25) -> DataFrame:
    """(point, area): ids as text of each point and area that holds it, once each."""
    cells = area_cells(areas, area_id, wkt, cell_deg)
    at = points.select(F.col(point_id).cast("string").alias("point"), F.col(lat).cast("double").alias("lat"), F.pmod(F.col(lon).cast("double"), F.lit(360.0)).alias("lon"), F.col(lon).cast("double").alias("raw"))
    at = at.where(F.col("point").isNotNull() & possible_position(F.col("lat"), F.col("raw"), 360.0)).drop("raw")
    at = at.withColumns({"row": F.floor(F.col("lat") / cell_deg).cast("bigint"), "col": F.floor(F.col("lon") / cell_deg).cast("bigint")})
    if cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = at.join(F.broadcast(cells), ["row", "col"])
    else:
        met = salted_join(at, cells, ["row", "col"], F.col("point"))
    return met.where(F.col("inside") | _odd_crossings(F.col("edges"), F.col("lon") + F.col("turn"), F.col("lat"))).select("point", "area").distinct()
