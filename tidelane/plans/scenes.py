"""Queries over footprints, roads, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import footprints as P
from tidelane.plans import domain as D
from tidelane.plans.registry import registry
from tidelane.runtime import read_table, shared_folder
from tidelane.sources import files, sinks
from tidelane.streaming.daily import run_new_files

QUERIES, SQL, query = registry()


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


K = "111194.92664455873::double"


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, f"""ras as (select *, (lat_index + 0.5::double) / 20 as lat, (lon_index + 0.5::double) / 20 as lon from (
  select *, unnest(range(cast(floor(lon0 * 20) as bigint), cast(floor(lon1 * 20) as bigint) + 1)) as lon_index from (select *, unnest(range(cast(floor(lat0 * 20) as bigint), cast(floor(lat1 * 20) as bigint) + 1)) as lat_index from foot))),
r1 as (select *, (sat_lon0 - lon) * {K} * cos(radians(lat)) as x1, (sat_lat0 - lat) * {K} as y1, (sat_lon1 - lon) * {K} * cos(radians(lat)) as x2, (sat_lat1 - lat) * {K} as y2 from ras where lat between lat0 and lat1 and lon between lon0 and lon1),
r2 as (select *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from r1)""")
    + "select scene_id, lat_index, lon_index, round(degrees(atan2(sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)), altitude_m)), 4) as look_angle from r2")
def d15_rasterize_footprints(spark: SparkSession, d: str) -> DataFrame:
    r = P.rasterize(D.sight_foot(spark, d), 20)
    return r.withColumn("look_angle", F.round("look_angle", 4))


@query()
def d41_road_areas(spark: SparkSession, d: str) -> DataFrame:
    """Detections in the hull of where a road's traffic may appear; tracks by segment stand in for roads."""
    from pyspark.sql import Window

    p = D.ping(spark, d).select(F.col("seg_id").alias("road_id"), F.row_number().over(Window.partitionBy("seg_id").orderBy("ts")).alias("k"), "lat", "lon")
    h = P.hulls(P.displaced(P.road_points(p), 350.0, 13_000.0, 450.0, 60.0), "road_id")
    return h.select("road_id", F.size("corners").cast("bigint").alias("corners"), F.round(F.array_min(F.transform("corners", lambda c: c["lat"])), 4).alias("south"), F.round(F.array_max(F.transform("corners", lambda c: c["lat"])), 4).alias("north"))


@query(D.with_sql(D.DET) + "select detect_id, lat, lon from det where scene_id is not null")
def s3_geojson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Detections written as GeoJSON text by scene and read back."""
    x = D.det(spark, d).where("scene_id is not null")
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.create_map(F.lit("detect_id"), "detect_id").alias("properties"))
    docs = x.groupBy("scene_id").agg(F.collect_list(point).alias("features")).select(F.lit("FeatureCollection").alias("type"), "features")
    path = _scratch(spark, "geojson")
    sinks.as_ndjson(docs, path)
    back = spark.read.schema(files.FEATURES).json(path).select(F.explode("features").alias("f"))
    return back.select(F.col("f.properties")["detect_id"].alias("detect_id"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders")
def s6_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as gzipped CSV and read back with a schema (K5)."""
    path = _scratch(spark, "csv")
    sinks.as_csv(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, gzip=True)
    return files.csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_orderpriority string")


@query("select cast(ts as date) as date, event_type, count(*) + case when cast(ts as date) = date '2024-01-05' then 1000 else 0 end as n from events where cast(ts as date) <> date '2024-01-07' group by cast(ts as date), event_type")
def k1_overwrite_and_delete_days(spark: SparkSession, d: str) -> DataFrame:
    """A table by day: one day overwritten (K1), one appended (K2), one deleted (K3)."""
    g = read_table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    path = _scratch(spark, "days")
    one = F.col("date") == F.lit("2024-01-05").cast("date")
    last = F.col("date") == F.lit("2024-01-06").cast("date")
    sinks.overwrite_days(g.where(~last), path)
    sinks.append(g.where(last), path, "date")
    sinks.overwrite_days(g.where(one).withColumn("n", F.col("n") + 1000), path)
    sinks.delete_day(spark, path, "2024-01-07")
    return spark.read.schema(g.schema).parquet(path).select("date", "event_type", "n")


@query("select distinct cast(detect_timestamp as date) as date from detect_scene_match where cast(detect_timestamp as date) is not null and cast(detect_timestamp as date) not in (select ping_date from pipe_v20201001_5min where ping_date is not null)")
def k6_missing_days(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "detect_scene_match").select(F.to_date("detect_timestamp").alias("date"))
    return sinks.missing_days(raw, read_table(spark, d, "pipe_v20201001_5min").select(F.col("ping_date").alias("date")))


@query("select cast(ts as date) as date, count(*) as n, round(sum(value), 4) as total from events group by 1")
def st2_incremental_days(spark: SparkSession, d: str) -> DataFrame:
    """New files taken by a stream that ends when it has them all; a second run finds nothing new."""
    source, target, state = _scratch(spark, "in"), _scratch(spark, "out"), _scratch(spark, "state")
    e = read_table(spark, d, "events").select("event_id", "value", F.to_date("ts").alias("date"))
    e.write.parquet(source)
    make = lambda rows: rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    for _ in range(2):
        run_new_files(spark, source, "event_id bigint, value double, date date", make, target, state)
    return spark.read.schema("n bigint, total double, date date").parquet(target).select("date", "n", "total")
