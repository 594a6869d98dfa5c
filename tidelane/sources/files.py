"""Reading detections, footprints, grids and tables from files."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.bins import detect_id_text, scene_time

FEATURES = "type string, features array<struct<type:string, geometry:struct<type:string, coordinates:array<double>>, properties:map<string,string>>>"


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, start_time, end_time, lon, lat, detect_id) of every point in GeoJSON files named after their scene; unreadable files give no rows."""
    docs = spark.read.schema(FEATURES).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    scene = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:geo)?json$", 1)
    p = docs.select(scene.alias("scene_id"), F.explode("features").alias("f")).where("f.geometry.type = 'Point' and size(f.geometry.coordinates) >= 2")
    p = p.select("scene_id", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))
    return p.select("scene_id", scene_time(F.col("scene_id"), 1).alias("start_time"), scene_time(F.col("scene_id"), 2).alias("end_time"), "lon", "lat", detect_id_text(F.col("scene_id"), F.col("lon"), F.col("lat")).alias("detect_id"))


def _simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, with its first and farthest corner kept."""
    if tolerance <= 0 or len(ring) < 5:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep = {0, far, len(ring) - 1}
    todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = ring[a], ring[b], ring[a + 1 : b]
        d = q - p
        t = np.clip(((mid - p) @ d) / max(d @ d, 1e-300), 0, 1)
        off = np.hypot(*(mid - (p + t[:, None] * d)).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            m = a + 1 + k
            keep.add(m)
            todo += [(a, m), (m, b)]
    out = ring[sorted(keep)]
    return out if len(out) >= 4 else ring


def _wkt(polygons: list[list[np.ndarray]]) -> str:
    parts = ["(" + ", ".join("(" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in r) + ")" for r in rings) + ")" for rings in polygons]
    return "MULTIPOLYGON (" + ", ".join(parts) + ")"


def geojson_footprints(spark: SparkSession, path: str, tolerances: tuple[float, ...] = (0.0, 0.01, 0.05)) -> DataFrame:
    """(scene_id, footprint_wkt, footprint_wkt_1, ...): all polygons of each file as one multipolygon, plain and simplified; unreadable files give no row."""
    names = ["footprint_wkt", *(f"footprint_wkt_{k}" for k in range(1, len(tolerances)))]

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    features = json.loads(bytes(content))["features"]
                    polygons = []
                    for f in features:
                        g = f["geometry"]
                        for part in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else []:
                            polygons.append([np.array([c[:2] for c in ring], float) for ring in part])
                except (ValueError, KeyError, TypeError):
                    continue
                if polygons:
                    rows.append((name.rsplit("/", 1)[-1].rsplit(".", 1)[0], *(_wkt([[_simplified(r, t) for r in p] for p in polygons]) for t in tolerances)))
            yield pd.DataFrame(rows, columns=["scene_id", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*json").load(path).select("path", "content")
    return files.mapInPandas(read, ", ".join(["scene_id string", *(f"{n} string" for n in names)]))


def readable_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok): which files hold one JSON value."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", (F.try_parse_json("value").isNotNull() & (F.length(F.trim("value")) > 0)).alias("ok"))


def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of every CSV file (with header) inside zip archives."""
    fields = [f.strip().split()[0] for f in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".csv"):
                            with z.open(name) as f:
                                for chunk in pd.read_csv(f, chunksize=100_000):
                                    yield chunk.reindex(columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header, plain or gzipped."""
    return spark.read.schema(schema).option("header", True).csv(path)


def feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Feather (Arrow) files, record batch by record batch."""
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for content in batch["content"].to_pylist():
                with pa.ipc.open_file(io.BytesIO(content)) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def grid_files(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(file, lat, lon, v) of global grids in NumPy files, rows from north to south, values under `least` and NaN left out.

    The array format stands in for scientific grid formats, for which no reader is at hand.
    """

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)[::-1]
                y, x = np.nonzero(np.nan_to_num(a, nan=-np.inf) >= least)
                yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "lat": (y + 0.5) * 180.0 / a.shape[0] - 90, "lon": (x + 0.5) * 360.0 / a.shape[1] - 180, "v": a[y, x].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, lat double, lon double, v double")


def tile_arrays(spark: SparkSession, path: str, shape: tuple[int, ...]) -> DataFrame:
    """(tile_id, height, width, vals) of stacks of tiles in NumPy files (n, height, width); files of another shape are refused."""

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                if a.shape[1:] != shape:
                    raise ValueError(f"{name} holds tiles of {a.shape[1:]}, not {shape}")
                for i in range(0, len(a), 256):
                    part = a[i : i + 256]
                    yield pd.DataFrame({"tile_id": [f"{name.rsplit('/', 1)[-1]}/{i + k}" for k in range(len(part))], "height": shape[0], "width": shape[1], "vals": [t.ravel().astype(float).tolist() for t in part]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "tile_id string, height int, width int, vals array<double>")


def shape_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, part, k, lon, lat): corners of the lines and rings in shapefiles (.shp; shapes of types 3, 5 and their z and m forms).

    A shapefile is read as one block, as its records have no fixed size; other shapes are passed over.
    """

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                raw, at = bytes(content), 100
                while at + 12 <= len(raw):
                    record, words = struct.unpack_from(">ii", raw, at)
                    body = at + 8
                    kind = struct.unpack_from("<i", raw, body)[0]
                    if kind in (3, 5, 13, 15, 23, 25):
                        parts, points = struct.unpack_from("<ii", raw, body + 36)
                        heads = np.frombuffer(raw, "<i4", parts, body + 44)
                        xy = np.frombuffer(raw, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2)
                        part = np.searchsorted(heads, np.arange(points), side="right") - 1
                        yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "record": record, "part": part, "k": np.arange(points) - heads[part], "lon": xy[:, 0], "lat": xy[:, 1]})
                    at = body + 2 * words

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, record int, part int, k int, lon double, lat double")


def near_areas(corners: DataFrame, areas: DataFrame, radius_m: float, by: list[str]) -> DataFrame:
    """Corners (lat, lon, columns by) of the lines that come within the radius of a corner of an area (lat, lon): whole lines are kept."""
    from tidelane.operators.proximity import distance_join

    hit = distance_join(corners.select(*by, "lat", "lon"), areas.select("lat", "lon"), radius_m).select(*by).distinct()
    return corners.join(hit, by, "left_semi")


def every_second(positions: DataFrame) -> DataFrame:
    """(sat, t, lat, lon): positions of satellites (sat, t, lat, lon in whole seconds, sparse) at every second between, on straight lines."""
    from pyspark.sql import Window

    w = Window.partitionBy("sat").orderBy("t")
    p = positions.withColumns({"t1": F.lead("t").over(w), "lat1": F.lead("lat").over(w), "lon1": F.lead("lon").over(w)})
    n = F.unix_seconds("t1") - F.unix_seconds("t")
    p = p.withColumn("k", F.explode(F.when(F.col("t1").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), n - 1))))
    part = F.coalesce(F.try_divide("k", n), F.lit(0.0))
    return p.select("sat", F.timestamp_seconds(F.unix_seconds("t") + F.col("k")).alias("t"), (F.col("lat") + part * F.coalesce(F.col("lat1") - F.col("lat"), F.lit(0.0))).alias("lat"), (F.col("lon") + part * F.coalesce(F.col("lon1") - F.col("lon"), F.lit(0.0))).alias("lon"))
