"""Domain tables the queries share, as DataFrames and, for the oracle, as SQL common table expressions of the same name.

det: the latest version of each detection with a possible position (longitude in [-180, 180)), with derived attributes.
ping: one row for each segment and instant. vessel: attributes of a vessel by its number.
infra: each structure once. pred: model outputs of a detection. Attributes no table has are integer functions of the
columns, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.geo import possible_position, wrap_lon
from tidelane.runtime import read_table

INFRA = "infrastructure_repeat_cat_6m_v20220805"


def det(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "detect_scene_match").where(F.col("detect_id").isNotNull() & possible_position(F.col("detect_lat"), F.col("detect_lon"), 360.0))
    v = F.max(F.struct("loaded_at", "detect_timestamp", "detect_lat", "detect_lon", "score", "length_m", "presence", "ssvid", "scene_id", "confidence")).alias("v")
    r = rows.groupBy("detect_id").agg(v).select("detect_id", "v.*")
    lon = wrap_lon(F.col("detect_lon"))
    return r.select(
        "detect_id", "scene_id", F.nullif(F.trim("ssvid"), F.lit("")).alias("ssvid"), F.col("detect_timestamp").alias("ts"), F.to_date("detect_timestamp").alias("day"),
        F.col("detect_lat").alias("lat"), lon.alias("lon"), "score", "confidence", "length_m", "presence",
        F.floor(F.col("detect_lat") * 20).cast("bigint").alias("lat_index"), F.floor(lon * 20).cast("bigint").alias("lon_index"),
        F.concat(F.lit("E"), F.floor((lon + 180) / 60).cast("bigint").cast("string"), F.floor((F.col("detect_lat") + 90) / 60).cast("bigint").cast("string")).alias("iso3"),
    )


DET = """det as (
  select detect_id, scene_id, nullif(trim(ssvid), '') as ssvid, detect_timestamp as ts, cast(detect_timestamp as date) as day,
         detect_lat as lat, lon, score, confidence, length_m, presence,
         cast(floor(detect_lat * 20) as bigint) as lat_index, cast(floor(lon * 20) as bigint) as lon_index,
         'E' || cast(cast(floor((lon + 180) / 60) as bigint) as varchar) || cast(cast(floor((detect_lat + 90) / 60) as bigint) as varchar) as iso3
  from (select *, detect_lon + 180.0 - 360.0 * floor((detect_lon + 180.0) / 360.0) - 180.0 as lon,
               row_number() over (partition by detect_id order by loaded_at desc nulls last, detect_timestamp desc nulls last, detect_lat desc, detect_lon desc,
                 score desc nulls last, length_m desc nulls last, presence desc nulls last, ssvid desc nulls last, scene_id desc nulls last, confidence desc nulls last) as k
        from detect_scene_match
        where detect_id is not null and abs(detect_lat) <= 90 and detect_lon >= -180 and detect_lon <= 360)
  where k = 1)"""


def ping(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "pipe_v20201001_5min").where(F.col("seg_id").isNotNull() & possible_position(F.col("lat"), F.col("lon")) & F.col("ping_timestamp").isNotNull())
    v = F.min(F.struct("lat", "lon", F.coalesce("speed_knots", F.lit(-1.0)).alias("s"), F.coalesce("course", F.lit(-1.0)).alias("c"), F.coalesce("ssvid", F.lit("")).alias("ssvid"), F.coalesce("distance_from_shore_m", F.lit(-1.0)).alias("m"))).alias("v")
    r = rows.groupBy("seg_id", F.col("ping_timestamp").alias("ts")).agg(v).select("seg_id", "ts", "v.*")
    return r.select("seg_id", "ts", F.nullif("ssvid", F.lit("")).alias("ssvid"), "lat", "lon", F.nullif("s", F.lit(-1.0)).alias("speed"), F.nullif("c", F.lit(-1.0)).alias("course"), F.nullif("m", F.lit(-1.0)).alias("shore_m"))


PING = """ping as (
  select seg_id, ping_timestamp as ts, ssvid, lat, lon, speed_knots as speed, course, distance_from_shore_m as shore_m
  from (select *, row_number() over (partition by seg_id, ping_timestamp order by lat, lon, coalesce(speed_knots, -1.0), coalesce(course, -1.0), coalesce(ssvid, ''), coalesce(distance_from_shore_m, -1.0)) as k
        from pipe_v20201001_5min
        where seg_id is not null and ping_timestamp is not null and abs(lat) <= 90 and abs(lon) <= 180)
  where k = 1)"""


def vessel(spark: SparkSession, d: str) -> DataFrame:
    """Every numbered vessel of pings and detections."""
    a = read_table(spark, d, "pipe_v20201001_5min").select(F.trim("ssvid").alias("ssvid"))
    b = read_table(spark, d, "detect_scene_match").select(F.trim("ssvid").alias("ssvid"))
    n = F.expr("try_cast(ssvid as bigint)")
    v = a.union(b).distinct().withColumn("n", n).where("n is not null")
    classes = F.array(*[F.lit(x) for x in ("trawlers", "tuna_purse_seines", "drifting_longlines", "cargo", "tanker", "tug", "gear", "squid_jigger")])
    return v.select("ssvid", F.when(F.col("n") % 3 == 0, True).when(F.col("n") % 3 == 1, False).alias("on_fishing_list"), (10.0 + F.col("n") % 200).alias("best_length_m"), F.get(classes, (F.col("n") % 8).cast("int")).alias("best_class"))


VESSEL = """vessel as (
  select ssvid, case when n % 3 = 0 then true when n % 3 = 1 then false end as on_fishing_list, 10.0 + n % 200 as best_length_m,
         ['trawlers', 'tuna_purse_seines', 'drifting_longlines', 'cargo', 'tanker', 'tug', 'gear', 'squid_jigger'][cast(n % 8 as integer) + 1] as best_class
  from (select ssvid, try_cast(ssvid as bigint) as n from (select trim(ssvid) as ssvid from pipe_v20201001_5min union select trim(ssvid) from detect_scene_match))
  where n is not null)"""


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd model outputs, two rows for each detection with a length."""
    x = det(spark, d).where("length_m is not null").select("detect_id", F.floor(F.col("length_m") * 10).cast("bigint").alias("n"))
    rows = x.select("detect_id", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"))
    score = ((F.col("n") * 37 + F.col("odd") * 11) % 101) / 100.0
    return rows.select("detect_id", "odd", (score * 0.9).alias("fishing_33"), score.alias("fishing_50"), (score * 0.5 + 0.5).alias("fishing_66"))


PRED = """pred as (
  select detect_id, odd, s * 0.9::double as fishing_33, s as fishing_50, s * 0.5::double + 0.5::double as fishing_66
  from (select detect_id, odd, ((cast(floor(length_m * 10) as bigint) * 37 + odd * 11) % 101) / 100.0::double as s
        from det, (values (0), (1)) as o(odd) where length_m is not null))"""


def overpass(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each cell (20 to a degree) that holds a detection: overpasses, years with one, depth, distance to shore, and whether it lies on a road of ships."""
    cells = det(spark, d).select("lat_index", "lon_index").distinct()
    a, o = F.abs("lat_index"), F.abs("lon_index")
    return cells.withColumns({
        "overpasses": (a * 31 + o * 17) % 120, "years_with_overpass": (a + o) % 6, "depth_m": (a * 131 + o * 71) % 5000, "shore_km": (a * 57 + o * 29) % 400, "in_road": (a * 7 + o * 13) % 19 == 0,
    })


OVERPASS = """overpass as (select *, (a * 31 + o * 17) % 120 as overpasses, (a + o) % 6 as years_with_overpass, (a * 131 + o * 71) % 5000 as depth_m, (a * 57 + o * 29) % 400 as shore_km, (a * 7 + o * 13) % 19 = 0 as in_road
  from (select distinct lat_index, lon_index, abs(lat_index) as a, abs(lon_index) as o from det))"""


def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for azimuth ambiguities: a detection, how far it lies off the line of a source, and both lengths."""
    x = det(spark, d).where("length_m is not null").withColumn("n", F.floor(F.col("length_m") * 10).cast("bigint"))
    return x.where("n % 3 = 0").select("detect_id", (F.col("n") * 53 % 1000).alias("line_dist"), F.col("length_m").alias("ambiguity_length"), (F.col("n") * 7 % 300).alias("source_length"))


AMBIGUITY = """amb as (select detect_id, n * 53 % 1000 as line_dist, length_m as ambiguity_length, n * 7 % 300 as source_length
  from (select *, cast(floor(length_m * 10) as bigint) as n from det where length_m is not null) where n % 3 = 0)"""


def sight(spark: SparkSession, d: str) -> DataFrame:
    """Detections that follow a segment's first ping of each day after seven minutes, a little off its place."""
    first = ping(spark, d).groupBy("seg_id", F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "lat", "lon")).alias("v")).select("seg_id", "day", "v.*")
    cell = F.concat(F.lit("T"), F.date_format("day", "yyyyMMdd"), F.lit("_"), F.floor(F.col("lat") / 5).cast("bigint").cast("string"), F.lit("_"), F.floor(F.col("lon") / 5).cast("bigint").cast("string"))
    return first.select(F.concat("seg_id", F.lit("/"), F.date_format("day", "yyyyMMdd")).alias("detect_id"), cell.alias("scene_id"), (F.col("ts") + F.expr("interval 7 minutes")).alias("ts"), (F.col("lat") + 0.012).alias("lat"), (F.col("lon") - 0.008).alias("lon"))


SIGHT = """det as (
  select seg_id || '/' || strftime(day, '%Y%m%d') as detect_id, 'T' || strftime(day, '%Y%m%d') || '_' || cast(cast(floor(lat / 5) as bigint) as varchar) || '_' || cast(cast(floor(lon / 5) as bigint) as varchar) as scene_id,
         ts + interval 7 minutes as ts, lat + 0.012::double as lat, lon - 0.008::double as lon
  from (select *, cast(ts as date) as day, row_number() over (partition by seg_id, cast(ts as date) order by ts) as k from ping) where k = 1)"""


def sight_foot(spark: SparkSession, d: str) -> DataFrame:
    """The scenes of sight(), 25 seconds each, with a straight satellite track beside them."""
    g = sight(spark, d).groupBy("scene_id").agg((F.min("lat") - 0.2).alias("lat0"), (F.max("lat") + 0.2).alias("lat1"), (F.min("lon") - 0.2).alias("lon0"), (F.max("lon") + 0.2).alias("lon1"), F.min("ts").alias("start_time"))
    g = g.withColumn("end_time", F.col("start_time") + F.expr("interval 25 seconds"))
    return g.select("*", (F.col("lat0") - 0.1).alias("sat_lat0"), (F.col("lon1") + 4.0).alias("sat_lon0"), (F.col("lat0") + 1.4).alias("sat_lat1"), (F.col("lon1") + 3.7).alias("sat_lon1"), F.lit(700000.0).alias("altitude_m"))


SIGHT_FOOT = """foot as (
  select *, start_time + interval 25 seconds as end_time, lat0 - 0.1::double as sat_lat0, lon1 + 4.0::double as sat_lon0, lat0 + 1.4::double as sat_lat1, lon1 + 3.7::double as sat_lon1, 700000.0::double as altitude_m
  from (select scene_id, min(lat) - 0.2::double as lat0, max(lat) + 0.2::double as lat1, min(lon) - 0.2::double as lon0, max(lon) + 0.2::double as lon1, min(ts) as start_time from det group by 1))"""


def infra(spark: SparkSession, d: str) -> DataFrame:
    """Each structure once, in its latest version, with class scores by integer functions of its id."""
    rows = read_table(spark, d, INFRA).where(F.col("id").isNotNull() & possible_position(F.col("detect_lat"), F.col("detect_lon"), 360.0))
    v = F.max(F.struct("loaded_at", "midpoint", "detect_id", "detect_lat", "detect_lon", "length_m", "presence", "overpasses", "detections", F.get("iso_ter1", F.lit(0)).alias("first"), "by_angle")).alias("v")
    r = rows.groupBy("id").agg(v).select("id", "v.*")
    q = {k: ((F.col("id") * m + a) % 101) / 100.0 for k, m, a in (("wind", 37, 5), ("oil", 61, 17), ("other", 13, 40), ("noise", 29, 71))}
    return r.select(
        "id", F.to_date("midpoint").alias("midpoint"), "detect_id", F.col("detect_lat").alias("lat"), wrap_lon(F.col("detect_lon")).alias("lon"), "length_m", "presence", "overpasses", "detections",
        F.coalesce(F.nullif(F.trim("first"), F.lit("")), F.lit("None")).alias("iso3"), "by_angle", *[v.alias(k) for k, v in q.items()],
    )


INFRA_SQL = f"""infra as (
  select id, cast(midpoint as date) as midpoint, detect_id, detect_lat as lat, detect_lon + 180.0 - 360.0 * floor((detect_lon + 180.0) / 360.0) - 180.0 as lon,
         length_m, presence, overpasses, detections, coalesce(nullif(trim(iso_ter1[1]), ''), 'None') as iso3, by_angle,
         ((id * 37 + 5) % 101) / 100.0::double as wind, ((id * 61 + 17) % 101) / 100.0::double as oil,
         ((id * 13 + 40) % 101) / 100.0::double as other, ((id * 29 + 71) % 101) / 100.0::double as noise
  from (select *, row_number() over (partition by id order by loaded_at desc nulls last, midpoint desc nulls last, detect_id desc nulls last, detect_lat desc, detect_lon desc, length_m desc nulls last, presence desc nulls last) as k
        from {INFRA} where id is not null and abs(detect_lat) <= 90 and detect_lon >= -180 and detect_lon <= 360)
  where k = 1)"""


def hav_sql(a: str, b: str, radius: str = "6371000.0") -> str:
    """Great-circle metres between rows a and b that have lat, lon."""
    return (
        f"2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def held_sql(points: str, point: str) -> str:
    """CTEs of oil_areas' rings and edges, and held (point, area_id): which area holds which row (lat, lon) of the points, by even-odd over each part's edges."""
    ring, rings = r"\([^()]+\)", r"\([^()]+\)(,\([^()]+\))*"
    return rf"""wk as (select distinct area_id, regexp_replace(regexp_replace(regexp_replace(trim(geometry), '^(?i)(?:SRID *= *[0-9]+ *; *)?(MULTIPOLYGON|POLYGON) *(?:ZM|Z|M)? *\(', '\1('), '\s+', ' ', 'g'), ' ?([(),]) ?', '\1', 'g') as g from oil_areas where geometry is not null and area_id is not null),
pt as (select area_id, g, generate_subscripts(parts, 1) as part, unnest(parts) as body from (select *, regexp_extract_all(g, '\(({ring}(?:,{ring})*)\)', 1) as parts from wk
  where regexp_full_match(g, '(?i)POLYGON\({rings}\)') or regexp_full_match(g, '(?i)MULTIPOLYGON\(\({rings}\)(,\({rings}\))*\)'))),
xy as (select *, list_transform(pts, lambda p: try_cast(string_split(p, ' ')[1] as double)) as xs, list_transform(pts, lambda p: try_cast(string_split(p, ' ')[2] as double)) as ys
  from (select area_id, g, part, string_split(unnest(regexp_extract_all(body, '\(([^()]+)\)', 1)), ',') as pts from pt)),
bad as (select area_id, g from xy where len(xs) < 4 or list_count(xs) < len(pts) or list_count(ys) < len(pts) or xs[1] <> xs[-1] or ys[1] <> ys[-1] or list_max(ys) > 90 or list_min(ys) < -90),
ed as (select area_id, g, part, xs[i] as x1, ys[i] as y1, xs[i + 1] as x2, ys[i + 1] as y2 from (select *, unnest(range(1, len(xs))) as i from xy where (area_id, g) not in (select (area_id, g) from bad))),
bx as (select area_id, g, part, min(least(x1, x2)) as x0, max(greatest(x1, x2)) as x9, min(least(y1, y2)) as y0, max(greatest(y1, y2)) as y9 from ed group by all),
held as (select distinct point, area_id from (
  select p.{point} as point, e.area_id, e.g, e.part, k from {points} p, (values (-360.0::double), (0.0::double), (360.0::double)) as s(k), bx b, ed e
  where p.lat between b.y0 and b.y9 and p.lon + k between b.x0 and b.x9 and e.area_id = b.area_id and e.g = b.g and e.part = b.part and (e.y1 > p.lat) <> (e.y2 > p.lat)
    and p.lon + k < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
  group by all having count(*) % 2 = 1))"""


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def running(*keys: str, by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(by)
