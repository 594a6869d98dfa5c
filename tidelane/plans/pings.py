"""Queries over location pings and detections: stops and trips, nearness and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators.polygons import areas_holding
from tidelane.operators.proximity import near_pairs, positions
from tidelane.operators.trips import stops_and_trips
from tidelane.plans import domain as D
from tidelane.runtime import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = stops_and_trips(read_table(spark, d, "pipe_v20201001_5min"))
    return found.select("kind", F.col("device").alias("seg_id"), F.floor(F.col("start_us") / 1_000_000).cast("bigint").alias("start_s"), F.floor(F.col("end_us") / 1_000_000).cast("bigint").alias("end_s"))


def p1_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips with duration, distance, pings and, for stops, the centre."""
    found = stops_and_trips(read_table(spark, d, "pipe_v20201001_5min"))
    return found.select(
        F.col("device").alias("seg_id"), "kind", F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"),
        "duration_s", F.round("distance_m", 1).alias("distance_m"), "pings", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"),
    )


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return positions(read_table(spark, d, "detect_scene_match"), "detect_id", "detect_lat", "detect_lon", "loaded_at")


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(_detections(spark, d), 100.0).select("id_a", "id_b")


def p3_inside(spark: SparkSession, d: str) -> DataFrame:
    held = areas_holding(_detections(spark, d), read_table(spark, d, "oil_areas"), "id", "lat", "lon", "area_id", "geometry")
    return held.select(F.col("point").alias("detect_id"), F.col("area").alias("area_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = p3_near(spark, d).select(F.lit("near").alias("relation"), F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))
    return near.unionByName(p3_inside(spark, d).select(F.lit("inside").alias("relation"), F.col("detect_id").alias("key_a"), F.col("area_id").alias("key_b")))


QUERIES = {f.__name__: f for f in (p1_found, p1_trips, p3_found, p3_near, p3_inside)}

#: The latest version of each detection, as positions() takes it.
_LATEST = """det as (
  select detect_id, lat, lon from (
    select detect_id, detect_lat as lat, detect_lon - 360.0 * floor((detect_lon + 180.0) / 360.0) as lon,
           row_number() over (partition by detect_id order by loaded_at desc, detect_lat, detect_lon) as k
    from detect_scene_match
    where detect_id is not null and abs(detect_lat) <= 90 and detect_lon >= -180 and detect_lon <= 360) where k = 1)"""

#: The neighbourhood pairs once more, in the oracle through a coarser band that both rows of a pair must share.
SQL = {
    "p3_near": """
with v as (
  select detect_id, detect_lat as lat, detect_lon - 360.0 * floor((detect_lon + 180.0) / 360.0) as lon,
         row_number() over (partition by detect_id order by loaded_at desc, detect_lat, detect_lon) as k
  from detect_scene_match
  where detect_id is not null and abs(detect_lat) <= 90 and detect_lon >= -180 and detect_lon <= 360),
p as (select detect_id, radians(lat) as la, radians(lon) as lo, cast(floor(lat * 500) as bigint) as band from v where k = 1),
q as (select detect_id, la, lo, band + d as band from p, (values (-1), (0), (1)) as s(d))
select p.detect_id as id_a, q.detect_id as id_b
from p join q on p.band = q.band and p.detect_id < q.detect_id
where 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((p.la - q.la) / 2), 2) + cos(p.la) * cos(q.la) * pow(sin((p.lo - q.lo) / 2), 2)))) < 100
""",
    "p3_inside": D.with_sql(_LATEST, D.held_sql("det", "detect_id")) + "select point as detect_id, cast(area_id as varchar) as area_id from held",
}
SQL["p3_found"] = f"select 'near' as relation, id_a as key_a, id_b as key_b from ({SQL['p3_near']}) union all select 'inside', detect_id, area_id from ({SQL['p3_inside']})"
