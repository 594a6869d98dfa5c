"""Queries that match vessels to detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import bins, geo
from tidelane.functions.compat import safe_div
from tidelane.operators import matching as M
from tidelane.plans import domain as D
from tidelane.plans.registry import registry
from tidelane.runtime import read_table

QUERIES, SQL, query = registry()

LABELS = ("cargo_or_tanker", "drifting_longlines", "other", "purse_seines", "trawlers", "tug")
MINUTES = [bins.FIRST_MINUTE, *bins.MINUTE_EDGES]
#: Keys of the vessel's frame to a cell of the test raster.
CELL = 50.0


def raster(spark: SparkSession, d: str) -> DataFrame:
    """A probability raster by class, minutes and speed: 11 x 21 cells, integer functions of the keys."""
    grid = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in LABELS])).alias("l", "labels"))
    grid = grid.select("*", F.posexplode(F.array(*[F.lit(x) for x in MINUTES])).alias("m", "minutes_lower")).select("*", F.explode(F.array(*[F.lit(2 * x) for x in range(6)])).alias("speed_lower"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).select("*", F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("j"))
    p = ((F.col("i") * 7 + (F.col("j") + 10) * 13 + F.col("m") * 3 + F.col("speed_lower") * 5 + F.col("l") * 11) % 97) / 9700.0
    return grid.select("labels", *[F.col(c).cast("bigint").alias(c) for c in ("minutes_lower", "speed_lower", "i", "j")], p.alias("probability"))


RASTER = f"""raster as (
  select labels, minutes_lower, speed_lower, i, j, ((i * 7 + (j + 10) * 13 + m * 3 + speed_lower * 5 + l * 11) % 97) / 9700.0::double as probability
  from (select unnest({list(LABELS)}) as labels, unnest(range({len(LABELS)})) as l), (select unnest({MINUTES}) as minutes_lower, unnest(range({len(MINUTES)})) as m),
       (select unnest([0, 2, 4, 6, 8, 10]) as speed_lower), (select unnest(range(0, 11)) as i), (select unnest(range(-10, 11)) as j))"""


def step_sql(c: str, first: int, edges: list[int]) -> str:
    whens = " ".join(f"when {c} < {high} then {low}" for low, high in zip([first, *edges], edges))
    return f"case {whens} when {c} >= {edges[-1]} then {edges[-1]} end"


def speed_sql(c: str) -> str:
    return step_sql(c, 0, bins.SPEED_EDGES)


def minutes_sql(c: str) -> str:
    return step_sql(c, bins.FIRST_MINUTE, bins.MINUTE_EDGES)


LABEL_SQL = "case " + " ".join(f"when best_class = '{a}' then '{b}'" for a, b in bins.VESSEL_CLASSES.items()) + " else 'other' end"


def near_sql(c: str) -> str:
    return f"case when {c} > 180 then {c} - 360 when {c} < -180 then {c} + 360 else {c} end"


def rad_sql(lat: str) -> str:
    a, b = geo.RADIUS_EQUATOR_KM, geo.RADIUS_POLE_KM
    return f"sqrt((pow({a}::double * {a}::double * cos(radians({lat})), 2) + pow({b}::double * {b}::double * sin(radians({lat})), 2)) / (pow({a}::double * cos(radians({lat})), 2) + pow({b}::double * sin(radians({lat})), 2)))"


K = "111194.92664455873::double"  # metres of a degree on a sphere of 6371 km


def lagged(vessels: bool) -> str:
    return (
        "lag_ as (select *, lag(ts) over w as ts_before, lead(ts) over w as ts_after from ping where speed < 50 window w as (partition by seg_id order by ts))"
        if not vessels else f"""lag_ as (select p.*, {LABEL_SQL} as labels from (select *, lag(ts) over w as ts_before, lead(ts) over w as ts_after from ping where speed < 50 window w as (partition by seg_id order by ts)) p join vessel using (ssvid))"""
    )


AROUND = f"""met0 as (
  select p.*, q.detect_id, q.scene_id, q.ts as detect_ts, q.lat as r_lat, q.lon as r_lon, floor((epoch_us(q.ts) - epoch_us(p.ts)) / 1000000) / 60.0::double as delta_minutes
  from (select *, cast(floor(epoch(ts) / 32400) as bigint) as k from lag_) p
  join (select *, cast(floor(epoch(ts) / 32400) as bigint) + o as k from det, (values (-1), (0), (1)) as s(o)) q on p.k = q.k and abs(p.lat - q.lat) < 1.7
  where {D.hav_sql('p', 'q')} < 185200
    and ((p.ts <= q.ts and p.ts_after > q.ts) or (p.ts <= q.ts and p.ts_after is null) or (p.ts > q.ts and p.ts_before <= q.ts) or (p.ts > q.ts and p.ts_before is null))),
met as (
  select *, coalesce(abs(floor((epoch_us(detect_ts) - epoch_us(ts_before)) / 1000000) / 60.0) < 540, false) as previous_exists,
         coalesce(abs(floor((epoch_us(detect_ts) - epoch_us(ts_after)) / 1000000) / 60.0) < 540, false) as after_exists
  from met0 where abs(delta_minutes) < 540)"""

MOTION = f"""mot as (
  select scene_id, degrees(atan2((sat_lon1 - sat_lon0) * 111 * cos(radians(sat_lat1 / 2 + sat_lat0 / 2)), (sat_lat1 - sat_lat0) * 111)) as sat_course,
         2 * 6371000.0 * asin(sqrt(pow(sin(radians(sat_lat1 - sat_lat0) / 2), 2) + cos(radians(sat_lat0)) * cos(radians(sat_lat1)) * pow(sin(radians(sat_lon1 - sat_lon0) / 2), 2)))
           * ({rad_sql('sat_lat1')} + altitude_m / 1000) / {rad_sql('sat_lat1')} / (epoch(end_time) - epoch(start_time)) * 3600 / 1852.0 as sat_knots,
         sat_lat0, sat_lon0, sat_lat1, sat_lon1, altitude_m from foot)"""

SHIFTED = f"""sh1 as (
  select *, lat + speed * delta_minutes / 60.0 * cos(radians(course)) / 60.0 as lat_i, lon + speed * delta_minutes / 60.0 * sin(radians(course)) / (60.0 * cos(radians(lat))) as lon_raw from met join mot using (scene_id)),
sh2 as (select *, {near_sql('lon_raw')} as lon_i from sh1),
sh3 as (select *, (sat_lon0 - lon_i) * {K} * cos(radians(lat_i)) as sx1, (sat_lat0 - lat_i) * {K} as sy1, (sat_lon1 - lon_i) * {K} * cos(radians(lat_i)) as sx2, (sat_lat1 - lat_i) * {K} as sy2 from sh2),
sh4 as (select *, greatest(0.0, least(1.0, coalesce(-(sx1 * (sx2 - sx1) + sy1 * (sy2 - sy1)) / nullif(pow(sx2 - sx1, 2) + pow(sy2 - sy1, 2), 0), 0.0))) as tt from sh3),
sh5 as (select *, speed * sin(radians(course - sat_course)) * sqrt(pow(sqrt(pow(sx1 + tt * (sx2 - sx1), 2) + pow(sy1 + tt * (sy2 - sy1), 2)) / 1852.0, 2) + pow(altitude_m / 1852.0, 2)) / nullif(sat_knots, 0) as adj from sh4),
sh as (select * exclude (lat, lon), lat - adj * cos(radians(sat_course)) / 60 as lat, lon - adj * sin(radians(sat_course)) / (60 * cos(radians(lat))) as lon from sh5)"""

KEYED = f"""ky1 as (select *, 1000 / greatest(1.0, abs(delta_minutes)) as scale, 111.699::double * (r_lon - lon) * cos(radians(lat)) as u, 111.699::double * (r_lat - lat) as v from sh),
ky2 as (select *, (cos(radians(course)) * u - sin(radians(course)) * v) * scale as x_key, (cos(radians(course)) * v + sin(radians(course)) * u - speed * 1.852::double * delta_minutes / 60) * scale as y_key from ky1),
ky as (select *, x_key / {CELL} as x, y_key / {CELL} as y, cast(round(x_key / {CELL} - 0.5::double) as bigint) as x1, cast(round(x_key / {CELL} + 0.5::double) as bigint) as x2, cast(round(y_key / {CELL} - 0.5::double) as bigint) as y1,
  cast(round(y_key / {CELL} + 0.5::double) as bigint) as y2, {minutes_sql('delta_minutes')} as mk, {speed_sql('speed')} as sk from ky2 where abs(x_key) <= 500 and abs(y_key) <= 500)"""


def scored(by_class: bool) -> str:
    r = "raster" if by_class else "flat"
    on = lambda c: f"{c}.minutes_lower = k.mk and {c}.speed_lower = k.sk" + (f" and {c}.labels = k.labels" if by_class else "")
    keys = ("labels, " if by_class else "") + "minutes_lower, speed_lower"
    corners = " ".join(f"left join {r} c{i}{j} on {on(f'c{i}{j}')} and c{i}{j}.i = abs(k.x{i}) and c{i}{j}.j = k.y{j}" for i in (1, 2) for j in (1, 2))
    return f"""wt as (select {keys}, sum(case when i > 0 then 2 else 1 end * probability * probability) as weight from {r} group by all),
pr as (select k.*, coalesce(wt.weight / (scale * scale), 0) as w,
    coalesce(c11.probability, 0) * (x2 - x) / (x2 - x1) * (y2 - y) / (y2 - y1) + coalesce(c21.probability, 0) * (x - x1) / (x2 - x1) * (y2 - y) / (y2 - y1)
  + coalesce(c12.probability, 0) * (x2 - x) / (x2 - x1) * (y - y1) / (y2 - y1) + coalesce(c22.probability, 0) * (x - x1) / (x2 - x1) * (y - y1) / (y2 - y1) as probability
  from ky k {corners} left join wt on {on('wt')})"""


SCORED = {by_class: scored(by_class) for by_class in (True, False)}
SCORE = """select ssvid, scene_id, detect_id, round(score, 8) as score from (
  select a.ssvid, a.scene_id, a.detect_id, (coalesce(a.probability, 0) * a.w + coalesce(b.probability, 0) * coalesce(b.w, 0)) / nullif(a.w + coalesce(b.w, 0), 0) as score
  from pr a left join pr b on a.ssvid = b.ssvid and a.detect_id = b.detect_id and a.ts > b.ts
  where not (b.ts is null and (a.previous_exists or a.after_exists)))
where score > 0"""


FLAT = "flat as (select minutes_lower, speed_lower, i, j, avg(probability) as probability from raster group by all)"


def _ping(spark: SparkSession, d: str) -> DataFrame:
    return D.ping(spark, d)


@query(D.with_sql(D.PING, D.SIGHT, D.VESSEL, D.SIGHT_FOOT, RASTER, lagged(True), AROUND, MOTION, SHIFTED, KEYED, SCORED[True]) + SCORE)
def d2_score_ais(spark: SparkSession, d: str) -> DataFrame:
    s = M.score_pings(_ping(spark, d), D.sight(spark, d), D.sight_foot(spark, d), raster(spark, d), D.vessel(spark, d), CELL)
    return s.withColumn("score", F.round("score", 8))


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, RASTER, FLAT, lagged(False), AROUND, MOTION, SHIFTED, KEYED, SCORED[False]) + SCORE)
def d3_score_without_class(spark: SparkSession, d: str) -> DataFrame:
    flat = raster(spark, d).groupBy("minutes_lower", "speed_lower", "i", "j").agg(F.avg("probability").alias("probability"))
    s = M.score_pings(_ping(spark, d), D.sight(spark, d), D.sight_foot(spark, d), flat, None, CELL)
    return s.withColumn("score", F.round("score", 8))


@query(D.with_sql(D.PING) + "select seg_id, ts, lag(ts) over w as ts_before, lead(ts) over w as ts_after from ping window w as (partition by seg_id order by ts)")
def w1_lead_lag(spark: SparkSession, d: str) -> DataFrame:
    return M.neighbours_in_time(_ping(spark, d)).select("seg_id", "ts", "ts_before", "ts_after")


@query(D.with_sql(D.PING, D.SIGHT, lagged(False), AROUND) + "select seg_id, ts, detect_id, round(delta_minutes, 6) as delta_minutes, previous_exists, after_exists from met")
def j11_around_image(spark: SparkSession, d: str) -> DataFrame:
    m = M.around_image(M.neighbours_in_time(_ping(spark, d).where("speed < 50")), D.sight(spark, d))
    return m.select("seg_id", "ts", "detect_id", F.round("delta_minutes", 6).alias("delta_minutes"), "previous_exists", "after_exists")


@query(D.with_sql(D.PING, D.SIGHT, lagged(False), AROUND) + "select a.ssvid, a.detect_id, a.ts, b.ts as b_ts, round(a.delta_minutes, 6) as a_delta_minutes, round(b.delta_minutes, 6) as b_delta_minutes from met a left join met b on a.ssvid = b.ssvid and a.detect_id = b.detect_id and a.ts > b.ts where not (b.ts is null and (a.previous_exists or a.after_exists))")
def j12_pair_pings(spark: SparkSession, d: str) -> DataFrame:
    m = M.pair_pings(M.around_image(M.neighbours_in_time(_ping(spark, d).where("speed < 50")), D.sight(spark, d)), ["delta_minutes"])
    return m.select("ssvid", "detect_id", "ts", "b_ts", F.round("a_delta_minutes", 6).alias("a_delta_minutes"), F.round("b_delta_minutes", 6).alias("b_delta_minutes"))


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, lagged(False), AROUND, MOTION, SHIFTED) + "select seg_id, ts, detect_id, round(lat_i, 6) as lat_i, round(lon_i, 6) as lon_i, round(adj, 6) + 0.0::double as adj, round(lat, 6) as lat, round(lon, 6) as lon from sh")
def f20_doppler_shift(spark: SparkSession, d: str) -> DataFrame:
    """Dead reckoning (F17), satellite course and speed (F19) and the Doppler offset of pings around an image."""
    m = M.doppler_shifted(M.around_image(M.neighbours_in_time(_ping(spark, d).where("speed < 50")), D.sight(spark, d)), M.satellite_motion(D.sight_foot(spark, d)))
    return m.select("seg_id", "ts", "detect_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lat_i", "lon_i", "adj", "lat", "lon")])


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, MOTION) + f"select scene_id, round(sat_course, 6) as sat_course, round(sat_knots, 4) as sat_knots, round({rad_sql('sat_lat1')}, 6) as radius_km from mot")
def f19_satellite_motion(spark: SparkSession, d: str) -> DataFrame:
    m = M.satellite_motion(D.sight_foot(spark, d))
    return m.select("scene_id", F.round("sat_course", 6).alias("sat_course"), F.round("sat_knots", 4).alias("sat_knots"), F.round(geo.earth_radius_km(F.col("sat_lat1")), 6).alias("radius_km"))


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, lagged(False), AROUND, MOTION, SHIFTED, KEYED) + "select seg_id, ts, detect_id, round(scale, 6) as scale, round(x_key, 4) as x_key, round(y_key, 4) as y_key, mk as minutes_lower, sk as speed_lower from ky")
def f21_vessel_frame(spark: SparkSession, d: str) -> DataFrame:
    """Detections in the frame of the vessel, with the step maps of minutes and speed."""
    m = M.frame_keys(M.doppler_shifted(M.around_image(M.neighbours_in_time(_ping(spark, d).where("speed < 50")), D.sight(spark, d)), M.satellite_motion(D.sight_foot(spark, d))))
    return m.select("seg_id", "ts", "detect_id", F.round("scale", 6).alias("scale"), F.round("x_key", 4).alias("x_key"), F.round("y_key", 4).alias("y_key"), bins.minutes_bin(F.col("delta_minutes")).alias("minutes_lower"), bins.speed_bin(F.col("speed")).alias("speed_lower"))


@query(D.with_sql(RASTER) + """select labels, minutes_lower, speed_lower, round(sum(case when i > 0 then 2 else 1 end * probability * probability), 8) as weight from (
  select * from raster union all select 'fishing' as labels, minutes_lower, speed_lower, i, j, avg(probability) from raster where labels in ('trawlers', 'purse_seines', 'drifting_longlines') group by all) group by all""")
def a16_raster_weights(spark: SparkSession, d: str) -> DataFrame:
    w = M.raster_weights(M.composite_raster(raster(spark, d)), ["labels", "minutes_lower", "speed_lower"])
    return w.withColumn("weight", F.round("weight", 8))


# ---- pairs of vessel and detection --------------------------------------------------------------------------------

PAIRS = "pairs as (select scene_id, ssvid, detect_id, max(score) as score from score_mult where scene_id is not null and ssvid is not null and detect_id is not null and score is not null and not isnan(score) group by all)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "score_mult").where("scene_id is not null and ssvid is not null and detect_id is not null and score is not null and not isnan(score)")
    return rows.groupBy("scene_id", "ssvid", "detect_id").agg(F.max("score").alias("score"))


@query(D.with_sql(PAIRS) + "select *, row_number() over (partition by detect_id order by score desc, detect_id, scene_id, ssvid) as rank_detection, row_number() over (partition by scene_id, ssvid order by score desc, scene_id, ssvid, detect_id) as rank_vessel from (select scene_id, ssvid, detect_id, round(score, 12) as score from pairs)")
def w3_dual_rank(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_pairs(pairs(spark, d).withColumn("score", F.round("score", 12)), ["detect_id"], ["scene_id", "ssvid"], names=("rank_detection", "rank_vessel"))


GEAR = [r"(.*)([\s]+[0-9]+%)$", r"[0-9]\.[0-9]V", r"(.*)[@]+([0-9]+V[0-9]?)$", "BOUY", "BUOY", "NET MARK", "NETMARK", "NETFISHING", "NET FISHING", r"^[0-9]*\-[0-9]*$"]  # fixed values: names of gear
NAME_SQL = "case n % 11 when 0 then 'BUOY ' || ssvid when 1 then 'NET MARK' when 2 then ssvid || ' 87%' when 3 then ssvid || '-12' else 'SHIP ' || ssvid end"


def _named(spark: SparkSession, d: str) -> DataFrame:
    v = D.vessel(spark, d).withColumn("n", F.expr("try_cast(ssvid as bigint) % 11"))
    name = F.when(F.col("n") == 0, F.concat(F.lit("BUOY "), "ssvid")).when(F.col("n") == 1, "NET MARK").when(F.col("n") == 2, F.concat("ssvid", F.lit(" 87%"))).when(F.col("n") == 3, F.concat("ssvid", F.lit("-12"))).otherwise(F.concat(F.lit("SHIP "), "ssvid"))
    return v.withColumn("shipname", name)


@query(D.with_sql(D.VESSEL, f"named as (select *, {NAME_SQL} as shipname from (select *, try_cast(ssvid as bigint) as n from vessel))") + "select ssvid, shipname from named where not (best_class = 'gear' or " + " or ".join(f"regexp_matches(shipname, '{g}')" for g in GEAR) + ")")
def sel_p6_without_gear(spark: SparkSession, d: str) -> DataFrame:
    v = _named(spark, d)
    gear = F.col("best_class") == "gear"
    for g in GEAR:
        gear = gear | F.col("shipname").rlike(g)
    return v.where(~gear).select("ssvid", "shipname")


@query(D.with_sql(PAIRS, D.VESSEL, f"named as (select *, {NAME_SQL} as shipname from (select *, try_cast(ssvid as bigint) as n from vessel))", "gear as (select ssvid from named where best_class = 'gear' or " + " or ".join(f"regexp_matches(shipname, '{g}')" for g in GEAR) + ")",
    "un as (select 'AIS' || ssvid as ssvid_source, * from pairs where score > 1e-5::double and ssvid not in (select ssvid from gear) union all select 'VMS' || ssvid as ssvid_source, * from pairs where score > 1)")
    + "select ssvid_source, scene_id, detect_id, row_number() over (partition by detect_id order by score desc, detect_id, ssvid_source, scene_id) as rank_detection, row_number() over (partition by ssvid_source, scene_id order by score desc, ssvid_source, scene_id, detect_id) as rank_vessel from un")
def d4_rank_matches(spark: SparkSession, d: str) -> DataFrame:
    gear = F.col("best_class") == "gear"
    for g in GEAR:
        gear = gear | F.col("shipname").rlike(g)
    p = pairs(spark, d)
    ais = p.where("score > 1e-5").join(_named(spark, d).where(gear).select("ssvid"), "ssvid", "left_anti").withColumn("ssvid_source", F.concat(F.lit("AIS"), "ssvid"))
    vms = p.where("score > 1").withColumn("ssvid_source", F.concat(F.lit("VMS"), "ssvid"))
    ranked = M.rank_pairs(ais.unionByName(vms), ["detect_id"], ["ssvid_source", "scene_id"], names=("rank_detection", "rank_vessel"))
    return ranked.select("ssvid_source", "scene_id", "detect_id", "rank_detection", "rank_vessel")


def _rounds_sql() -> str:
    parts, src = [], "pairs"
    for r in range(1, 5):
        parts.append(f"""r{r} as (select *, row_number() over (partition by detect_id order by score desc, scene_id, ssvid, detect_id) as a, row_number() over (partition by scene_id, ssvid order by score desc, scene_id, ssvid, detect_id) as b from {src}),
m{r} as (select scene_id, ssvid, detect_id, score, {r} as round from r{r} where a = 1 and b = 1),
o{r} as (select scene_id, ssvid, detect_id, score from {src} p where not exists (select 1 from m{r} m where m.scene_id = p.scene_id and m.ssvid = p.ssvid) and not exists (select 1 from m{r} m where m.detect_id = p.detect_id))""")
        src = f"o{r}"
    return ",\n".join(parts)


@query(D.with_sql(PAIRS, _rounds_sql()) + " union all ".join(f"select scene_id, ssvid, detect_id, round from m{r}" for r in range(1, 5)))
def d5_mutual_best(spark: SparkSession, d: str) -> DataFrame:
    return M.mutual_best(pairs(spark, d), ["scene_id", "ssvid"], ["detect_id"]).select("scene_id", "ssvid", "detect_id", "round")


@query(D.with_sql(D.DET, PAIRS, _rounds_sql(), "top as (" + " union all ".join(f"select scene_id, ssvid, detect_id, score from m{r}" for r in range(1, 5)) + ")")
    + "select coalesce(t.detect_id, d.detect_id) as detect_id, t.ssvid, d.lat, d.lon, round(coalesce(t.score, 0), 12) as score from top t full join det d on t.detect_id = d.detect_id")
def j3_matches_with_detections(spark: SparkSession, d: str) -> DataFrame:
    """Full outer: matches beside detections, either may be missing."""
    top = M.mutual_best(pairs(spark, d), ["scene_id", "ssvid"], ["detect_id"]).select("detect_id", "ssvid", "score")
    out = top.join(D.det(spark, d).select("detect_id", "lat", "lon"), "detect_id", "full")
    return out.select("detect_id", "ssvid", "lat", "lon", F.round(F.coalesce("score", F.lit(0.0)), 12).alias("score"))


@query(D.with_sql(PAIRS) + "select scene_id, ssvid, detect_id, round(score / nullif(sqrt(sum(score) over (partition by scene_id, ssvid) * sum(score) over (partition by detect_id)), 0), 6) as confidence from pairs where score > 1e-9::double")
def d6_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = M.confidence(pairs(spark, d).where("score > 1e-9"), ["scene_id", "ssvid"], ["detect_id"])
    return c.select("scene_id", "ssvid", "detect_id", F.round("confidence", 6).alias("confidence"))


# ---- multiplied rasters --------------------------------------------------------------------------------------------

PPD, HALF_DEG = 10, 0.3
EXTRAP = f"""ext as (
  select e.ext_id, trim(e.ssvid) as ssvid, upper(trim(e.scene_id)) as scene_id, is_single, {LABEL_SQL} as label, greatest(coalesce(scale1, 0), coalesce(scale2, 0)) as scale, scale1, scale2, delta_minutes1, delta_minutes2, speed1, speed2, course1, course2,
         lat_extrapolate1 + lat_doppler_offset as lat_adj1, lon_extrapolate1 + lon_doppler_offset as lon_adj1, lat_extrapolate2 + lat_doppler_offset as lat_adj2, lon_extrapolate2 + lon_doppler_offset as lon_adj2
  from detect_foot_ext_doppler e join vessel v on trim(e.ssvid) = v.ssvid
  where e.scene_id is not null and (is_single or (abs(lat_extrapolate1 - lat_extrapolate2) < 10 and abs(lon_extrapolate1 - lon_extrapolate2) < 10)) and lat_doppler_offset is not null and lon_doppler_offset is not null)"""


def extrap(spark: SparkSession, d: str) -> DataFrame:
    """Extrapolations with their label and corrected positions. Two rasters of 500 km each way meet nowhere if their pings lie ten degrees apart."""
    e = read_table(spark, d, "detect_foot_ext_doppler").withColumns({"ssvid": F.trim("ssvid"), "scene_id": F.upper(F.trim("scene_id"))})
    e = e.where("scene_id is not null and (is_single or (abs(lat_extrapolate1 - lat_extrapolate2) < 10 and abs(lon_extrapolate1 - lon_extrapolate2) < 10)) and lat_doppler_offset is not null and lon_doppler_offset is not null")
    e = e.join(D.vessel(spark, d), "ssvid")
    adj = {f"{c}_adj{k}": F.col(f"{c}_extrapolate{k}") + F.col(f"{c}_doppler_offset") for k in (1, 2) for c in ("lat", "lon")}
    return e.withColumns({"label": bins.vessel_label(F.col("best_class")), "scale": F.greatest(F.coalesce("scale1", F.lit(0.0)), F.coalesce("scale2", F.lit(0.0))), **adj})


def _probe(k: int) -> str:
    x = f"(cos(radians(course{k})) * u{k} - sin(radians(course{k})) * v{k}) * scale{k}"
    y = f"(cos(radians(course{k})) * v{k} + sin(radians(course{k})) * u{k}) * scale{k}"
    return f"{x} as x{k}, {y} as y{k}, {minutes_sql(f'delta_minutes{k}')} as mk{k}, {speed_sql(f'speed{k}')} as sk{k}"


CELLS = f"""gr as (
  select *, {', '.join(f'111.699::double * (lon_bin / {PPD}.0::double - lon_adj{k}) * cos(radians(lat_adj{k})) as u{k}, 111.699::double * (lat_bin / {PPD}.0::double - lat_adj{k}) as v{k}' for k in (1, 2))}
  from (select *, unnest(range(cast(floor((least(lon_adj1, lon_adj2) - {HALF_DEG}) * {PPD}) as bigint) - 2, cast(floor((greatest(lon_adj1, lon_adj2) + {HALF_DEG}) * {PPD}) as bigint) + 3)) as lon_bin
        from (select *, unnest(range(cast(floor((least(lat_adj1, lat_adj2) - {HALF_DEG}) * {PPD}) as bigint) - 2, cast(floor((greatest(lat_adj1, lat_adj2) + {HALF_DEG}) * {PPD}) as bigint) + 3)) as lat_bin from ext))),
gk as (select *, {_probe(1)}, {_probe(2)} from gr),
cells as (select * from (
  select ext_id, ssvid, scene_id, lat_bin, lon_bin, case when is_single then coalesce(a.probability, b.probability) else a.probability * b.probability end as p
  from gk g left join raster a on a.labels = label and a.minutes_lower = mk1 and a.speed_lower = sk1 and abs(x1) <= 500 and abs(y1) <= 500 and a.i = abs(cast(round(x1 / {CELL}) as bigint)) and a.j = cast(round(y1 / {CELL}) as bigint)
  left join raster b on b.labels = label and b.minutes_lower = mk2 and b.speed_lower = sk2 and abs(x2) <= 500 and abs(y2) <= 500 and b.i = abs(cast(round(x2 / {CELL}) as bigint)) and b.j = cast(round(y2 / {CELL}) as bigint)) where p > 0)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return M.multiplied_cells(extrap(spark, d), raster(spark, d), PPD, CELL, HALF_DEG)


@query(D.with_sql(D.VESSEL, RASTER, EXTRAP, CELLS) + "select ext_id, count(*) as cells, round(sum(p) * 1e6, 4) as mass from cells group by 1")
def ar2_raster_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("ext_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("p") * 1e6, 4).alias("mass"))


PLACES = f"places as (select ext_id, detect_id, cast(round(lat * {PPD}) as bigint) as lat_bin, cast(round(lon * {PPD}) as bigint) as lon_bin from ext join det on upper(det.scene_id) = ext.scene_id where det.lat between least(lat_adj1, lat_adj2) - 1 and greatest(lat_adj1, lat_adj2) + 1)"


@query(D.with_sql(D.DET, D.VESSEL, RASTER, EXTRAP, CELLS, PLACES) + """select ext_id, detect_id, round(here / mass * scale * scale, 4) as score, round(top / mass * scale * scale, 4) as max_score, round(below / mass, 9) as likelihood from (
  select p.ext_id, p.detect_id, h.p as here, sum(c.p) as mass, max(c.p) as top, sum(case when c.p <= h.p then c.p else 0 end) as below
  from places p join cells h using (ext_id, lat_bin, lon_bin) join cells c on c.ext_id = p.ext_id group by all) join (select ext_id, scale from ext) using (ext_id)""")
def d8_score_multiplied(spark: SparkSession, d: str) -> DataFrame:
    """Scores from the product of both pings' rasters (A14 gives the mass ratios)."""
    e = extrap(spark, d)
    det = D.det(spark, d).select("detect_id", F.upper("scene_id").alias("scene_id"), "lat", "lon")
    near = (F.col("lat") >= F.least("lat_adj1", "lat_adj2") - 1) & (F.col("lat") <= F.greatest("lat_adj1", "lat_adj2") + 1)
    places = e.join(det, "scene_id").where(near).select("ext_id", "detect_id", F.round(F.col("lat") * PPD).cast("bigint").alias("lat_bin"), F.round(F.col("lon") * PPD).cast("bigint").alias("lon_bin"))
    s = M.mass_scores(_cells(spark, d), places, e.select("ext_id", "scale"))
    return s.select("ext_id", "detect_id", F.round("score", 4).alias("score"), F.round("max_score", 4).alias("max_score"), F.round("likelihood", 9).alias("likelihood"))


@query(D.with_sql(D.VESSEL, RASTER, EXTRAP) + f"""select ext_id, round(max(probability) / sum(probability) * scale1 * scale1, 4) as max_score, round(sum(case when probability <= 0.005 then probability else 0 end) / sum(probability), 6) as likelihood
  from (select *, {minutes_sql('delta_minutes1')} as mk, {speed_sql('speed1')} as sk from ext where delta_minutes1 is not null and scale1 is not null) e
  join (select * from raster union all select labels, minutes_lower, speed_lower, -i, j, probability from raster where i > 0) r on r.labels = e.label and r.minutes_lower = mk and r.speed_lower = sk where probability > 0 group by ext_id, scale1""")
def d9_score_single(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood of a single ping from the raster alone; the raster's masses are totalled by key once, mirrored by weight."""
    r = raster(spark, d).where("probability > 0").withColumn("m", F.when(F.col("i") > 0, 2.0).otherwise(1.0) * F.col("probability"))
    mass = r.groupBy("labels", "minutes_lower", "speed_lower").agg(F.sum("m").alias("mass"), F.max("probability").alias("top"), F.sum(F.when(F.col("probability") <= 0.005, F.col("m")).otherwise(0.0)).alias("below"))
    e = extrap(spark, d).where("delta_minutes1 is not null and scale1 is not null").select("ext_id", "scale1", F.col("label").alias("labels"), bins.minutes_bin(F.col("delta_minutes1")).alias("minutes_lower"), bins.speed_bin(F.col("speed1")).alias("speed_lower"))
    s = e.join(M.small(mass), ["labels", "minutes_lower", "speed_lower"])
    return s.select("ext_id", F.round(F.col("top") / F.col("mass") * F.col("scale1") * F.col("scale1"), 4).alias("max_score"), F.round(F.col("below") / F.col("mass"), 6).alias("likelihood"))


@query(D.with_sql(D.DET, D.VESSEL, RASTER, EXTRAP, CELLS, "imaged as (select distinct scene_id, lat_bin, lon_bin from (select upper(scene_id) as scene_id, cast(floor(lat * 10) as bigint) + a as lat_bin, cast(floor(lon * 10) as bigint) + b as lon_bin from det, (values (-1), (0), (1)) as s(a), (values (-1), (0), (1)) as t(b)))")
    + "select ext_id, round(coalesce(p, 1), 6) as prob_inside from ext left join (select ext_id, sum(case when i.scene_id is not null then p else 0 end) / sum(p) as p from cells c left join imaged i on c.scene_id = i.scene_id and c.lat_bin = i.lat_bin and c.lon_bin = i.lon_bin group by 1) using (ext_id)")
def d12_likelihood_inside(spark: SparkSession, d: str) -> DataFrame:
    """Share of a vessel's probability in imaged cells (A15); 1 where nothing was computed."""
    det = D.det(spark, d).select(F.upper("scene_id").alias("scene_id"), F.floor(F.col("lat") * 10).cast("bigint").alias("y"), F.floor(F.col("lon") * 10).cast("bigint").alias("x"))
    imaged = det.select("scene_id", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("lat_bin"), "x").select("scene_id", "lat_bin", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("lon_bin")).distinct()
    share = _cells(spark, d).join(imaged.withColumn("seen", F.lit(True)), ["scene_id", "lat_bin", "lon_bin"], "left").groupBy("ext_id").agg((F.sum(F.when(F.col("seen"), F.col("p")).otherwise(0.0)) / F.sum("p")).alias("p"))
    return extrap(spark, d).select("ext_id").join(share, "ext_id", "left").select("ext_id", F.round(F.coalesce("p", F.lit(1.0)), 6).alias("prob_inside"))


MATCHED = "mat as (select d.length_m, v.best_length_m, d.detect_id, d.ssvid, d.score, d.scene_id from det d join vessel v using (ssvid) where d.length_m is not null)"


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return D.det(spark, d).where("length_m is not null").join(D.vessel(spark, d), "ssvid")


PRIOR = "pri as (select frac10, number / sum(number) over () as probability from (select cast(floor((best_length_m - length_m) / best_length_m * 10) as bigint) as frac10, count(*) as number from mat where score > 1e-5::double group by 1) where frac10 is not null)"


@query(D.with_sql(D.DET, D.VESSEL, MATCHED, PRIOR) + "select frac10, round(probability, 8) as probability from pri")
def d10_length_prior(spark: SparkSession, d: str) -> DataFrame:
    """Histogram over a total: the cross join with one row."""
    return M.length_prior(_matched(spark, d).where("score > 1e-5")).withColumn("probability", F.round("probability", 8))


_LEN_SQL = "case when best_length_m < 30 then floor(best_length_m / 2) * 2 + 1 when best_length_m between 30 and 59.9999999 then floor(best_length_m / 4) * 4 + 2 when best_length_m > 60 and best_length_m < 200 then floor(best_length_m / 20) * 20 + 10 when best_length_m >= 200 then 200 else -20 end"
NEAREST = f"""nst as (select e.ssvid, e.scene_id, cast({_LEN_SQL} as bigint) as length_bin, cast(case when m < 1000 then floor(m / 100) * 100 else 1000 end as bigint) as distance_bin
  from mat e left join (select a.ssvid, a.scene_id, min({D.hav_sql('a', 'b')}) as m from det a join det b on a.scene_id = b.scene_id and a.ssvid <> b.ssvid group by 1, 2) x on e.ssvid = x.ssvid and e.scene_id = x.scene_id)"""


def nearest_other(det: DataFrame) -> DataFrame:
    """(ssvid, scene_id, min_m): distance to the nearest other vessel of the same scene."""
    a = det.where("ssvid is not null and scene_id is not null").select("ssvid", "scene_id", "lat", "lon")
    b = a.toDF("ssvid2", "scene_id", "lat2", "lon2")
    return a.join(b, "scene_id").where("ssvid <> ssvid2").groupBy("ssvid", "scene_id").agg(F.min(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("min_m"))


@query(D.with_sql(D.DET) + f"select a.ssvid, a.scene_id, round(min({D.hav_sql('a', 'b')}), 3) as min_m from det a join det b on a.scene_id = b.scene_id and a.ssvid <> b.ssvid group by 1, 2")
def j14_nearest_in_scene(spark: SparkSession, d: str) -> DataFrame:
    return nearest_other(D.det(spark, d)).withColumn("min_m", F.round("min_m", 3))


RECALL = "rec as (select length_bin, distance_bin, (least(length_bin, 200) + 40 + distance_bin / 10.0::double) / 400.0::double as recall from (select distinct length_bin, distance_bin from nst))"


@query(D.with_sql(D.DET, D.VESSEL, MATCHED, NEAREST, RECALL) + "select scene_id, count(*) as vessels, round(sum(recall), 6) as expected from nst join rec using (length_bin, distance_bin) group by 1")
def d13_expected_recall(spark: SparkSession, d: str) -> DataFrame:
    """Expected matches of a scene: recall looked up by bins of length and of distance to the nearest vessel."""
    m = _matched(spark, d).join(nearest_other(D.det(spark, d)), ["ssvid", "scene_id"], "left")
    m = m.select("scene_id", bins.length_bin(F.col("best_length_m")).alias("length_bin"), bins.distance_bin(F.col("min_m")).alias("distance_bin"))
    lookup = m.select("length_bin", "distance_bin").distinct().withColumn("recall", (F.least(F.col("length_bin"), F.lit(200)) + 40 + F.col("distance_bin") / 10.0) / 400.0)
    return m.join(M.small(lookup), ["length_bin", "distance_bin"]).groupBy("scene_id").agg(F.count(F.lit(1)).alias("vessels"), F.round(F.sum("recall"), 6).alias("expected"))


@query(D.with_sql(D.DET, D.VESSEL, MATCHED, PRIOR, "old as (select scene_id, ssvid, detect_id, max(score) as score_mult, count(*) as n from score_mult where score is not null and not isnan(score) group by all)",
    """cmb as (select o.scene_id, o.ssvid, o.detect_id, case when n > 1 then score_mult / 2 else score_mult end as score, (n % 10 + 1) / 12.0::double as recall, case when p.probability is not null then p.probability when m.best_length_m is null then 0.09::double * 0.5 else 1e-6::double end as prob_length
  from old o left join mat m on o.detect_id = m.detect_id and o.ssvid = m.ssvid left join pri p on p.frac10 = cast(floor((m.best_length_m - m.length_m) / m.best_length_m * 10) as bigint))""")
    + "select scene_id, ssvid, detect_id, round(score * recall, 10) as with_recall, round(score * recall * prob_length, 10) as with_length from cmb where ssvid is not null")
def d11_combined_score(spark: SparkSession, d: str) -> DataFrame:
    """Score variants: averaged where repeated, times recall, times the length prior."""
    rows = read_table(spark, d, "score_mult").where("score is not null and not isnan(score) and ssvid is not null and scene_id is not null and detect_id is not null")
    old = rows.groupBy("scene_id", "ssvid", "detect_id").agg(F.max("score").alias("score_mult"), F.count(F.lit(1)).alias("n"))
    m = _matched(spark, d)
    prior = M.length_prior(m.where("score > 1e-5"))
    x = old.join(m.select("detect_id", "ssvid", "best_length_m", "length_m"), ["detect_id", "ssvid"], "left").withColumn("frac10", M.length_difference(F.col("best_length_m"), F.col("length_m"))).join(M.small(prior), "frac10", "left")
    score = F.when(F.col("n") > 1, F.col("score_mult") / 2).otherwise(F.col("score_mult")) * ((F.col("n") % 10 + 1) / 12.0)
    return x.select("scene_id", "ssvid", "detect_id", F.round(score, 10).alias("with_recall"), F.round(score * M.length_factor(F.col("probability"), F.col("best_length_m").isNotNull()), 10).alias("with_length"))


@query(D.with_sql(PAIRS) + "select t as threshold, count(*) filter (score > t) as matches from pairs, (select unnest([7.1e-6, 7.2e-6, 7.3e-6, 7.4e-6, 7.5e-6, 1e-3, 1.0]) as t) group by 1")
def d14_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Matches above each threshold."""
    return M.sweep(pairs(spark, d), [7.1e-6, 7.2e-6, 7.3e-6, 7.4e-6, 7.5e-6, 1e-3, 1.0])


@query(D.with_sql(D.DET, PAIRS, D.VESSEL) + """select length_bin, distance_bin, n, round(m1 / n, 6) as recall1, round(m2 / n, 6) as recall2 from (
  select cast(floor(length_m / 20) * 20 as bigint) as length_bin, cast(least(floor(abs(lat) / 10), 5) as bigint) as distance_bin, count(*)::double as n, count(*) filter (s > 1e-5::double) as m1, count(*) filter (s > 1) as m2
  from det left join (select detect_id, max(score) as s from pairs group by 1) using (detect_id) where length_m is not null and not isnan(length_m) group by 1, 2)""")
def a17_recall_table(spark: SparkSession, d: str) -> DataFrame:
    best = pairs(spark, d).groupBy("detect_id").agg(F.max("score").alias("s"))
    x = D.det(spark, d).where("length_m is not null and not isnan(length_m)").join(best, "detect_id", "left")
    g = x.groupBy((F.floor(F.col("length_m") / 20) * 20).cast("bigint").alias("length_bin"), F.least(F.floor(F.abs("lat") / 10), F.lit(5)).cast("bigint").alias("distance_bin"))
    n = F.count(F.lit(1)).cast("double")
    return g.agg(n.alias("n"), F.round(F.count_if(F.col("s") > 1e-5) / n, 6).alias("recall1"), F.round(F.count_if(F.col("s") > 1) / n, 6).alias("recall2"))


# ---- vessels in scenes ---------------------------------------------------------------------------------------------

IMAGES = "img as (select scene_id, lat0, lat1, lon0, lon1, start_time as image_time from foot)"
SPANS = """spn as (
  select ssvid, lat, lon, ts, speed, course, lead(lat) over w as lat2, lead(lon) over w as lon2, lead(ts) over w as ts2, lead(speed) over w as speed2, lead(course) over w as course2 from ping window w as (partition by seg_id order by ts)
  union all select ssvid, null, null, null, null, null, lat, lon, ts, speed, course from (select *, row_number() over (partition by seg_id order by ts) as k from ping) where k = 1)"""


def track_spans(ping: DataFrame) -> DataFrame:
    """Each ping with the next of its segment, and one row with only the second ping for each segment's start."""
    w = Window.partitionBy("seg_id").orderBy("ts")
    cols = ["lat", "lon", "ts", "speed", "course"]
    p = ping.withColumns({**{f"{c}2": F.lead(c).over(w) for c in cols}, "first": F.lag("ts").over(w).isNull()})
    row = F.struct(*[F.col(c) for c in cols], *[F.col(f"{c}2") for c in cols])
    start = F.struct(*[F.lit(None).cast(p.schema[c].dataType).alias(c) for c in cols], *[F.col(c).alias(f"{c}2") for c in cols])
    return p.select("ssvid", F.explode(F.when(F.col("first"), F.array(row, start)).otherwise(F.array(row))).alias("r")).select("ssvid", "r.*")


def straddle_join(spans: DataFrame, scenes: DataFrame, pad_deg: float = 2.0, day_s: int = 86_400) -> DataFrame:
    """Spans that hold a scene's instant (either end may be missing) and have an end within the padded box.

    Closed spans meet scenes by the days they touch; open ones have no bound in time and meet scenes by cell of the box.
    """
    day = lambda c: F.floor(F.unix_micros(c) / 1_000_000 / day_s).cast("bigint")
    cell = 10
    near = lambda la, lo, sh: (F.col(la) > F.col("lat0") - pad_deg) & (F.col(la) < F.col("lat1") + pad_deg) & (F.col(lo) > F.col("lon0") - pad_deg / F.cos(F.radians(sh))) & (F.col(lo) < F.col("lon1") + pad_deg / F.cos(F.radians(sh)))
    box = near("lat", "lon", F.coalesce("lat2", "lat")) | near("lat2", "lon2", F.coalesce("lat2", "lat"))
    inside = ((F.col("ts") < F.col("image_time")) & (F.col("ts2") >= F.col("image_time"))) | (F.col("ts2").isNull() & (F.col("ts") < F.col("image_time"))) | (F.col("ts").isNull() & (F.col("ts2") >= F.col("image_time")))
    closed = spans.where("ts is not null and ts2 is not null").withColumn("__d", F.explode(F.sequence(day("ts"), day("ts2")))).join(scenes.withColumn("__d", day("image_time")), "__d").drop("__d")
    lat = F.coalesce("lat2", "lat")
    open_ = spans.where("ts is null or ts2 is null").withColumn("__c", F.floor(lat / cell).cast("bigint"))
    low, high = F.floor((F.col("lat0") - pad_deg) / cell).cast("bigint"), F.floor((F.col("lat1") + pad_deg) / cell).cast("bigint")
    opened = open_.join(scenes.withColumn("__c", F.explode(F.sequence(low, high))), "__c").drop("__c")
    return closed.unionByName(opened).where(F.coalesce(inside, F.lit(False)) & F.coalesce(box, F.lit(False)))


CAND = """cnd as (select s.*, i.*, epoch(ts2) - epoch(image_time) as timeto2, epoch(image_time) - epoch(ts) as timeto from spn s join img i on
    ((ts < image_time and ts2 >= image_time) or (ts2 is null and ts < image_time) or (ts is null and ts2 >= image_time))
    and ((lat > lat0 - 2 and lat < lat1 + 2 and lon > lon0 - 2 / cos(radians(coalesce(lat2, lat))) and lon < lon1 + 2 / cos(radians(coalesce(lat2, lat))))
      or (lat2 > lat0 - 2 and lat2 < lat1 + 2 and lon2 > lon0 - 2 / cos(radians(coalesce(lat2, lat))) and lon2 < lon1 + 2 / cos(radians(coalesce(lat2, lat))))))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    scenes = D.sight_foot(spark, d).select("scene_id", "lat0", "lat1", "lon0", "lon1", F.col("start_time").alias("image_time"))
    c = straddle_join(track_spans(_ping(spark, d)), scenes)
    s = lambda x: F.unix_micros(x) / 1_000_000
    return c.withColumns({"timeto2": s("ts2") - s("image_time"), "timeto": s("image_time") - s("ts")})


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, IMAGES, SPANS, CAND) + "select ssvid, scene_id, ts, ts2, round(timeto, 3) as timeto, round(timeto2, 3) as timeto2 from cnd")
def j10_straddle_join(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("ssvid", "scene_id", "ts", "ts2", F.round("timeto", 3).alias("timeto"), F.round("timeto2", 3).alias("timeto2"))


D1_SQL = f"""pos as (select *, (lat * timeto2 + lat2 * timeto) / nullif(timeto + timeto2, 0) as lat_c,
    case when abs(lon - lon2) > 180 then ((case when lon < 0 then lon + 360 else lon end) * timeto2 + (case when lon2 < 0 then lon2 + 360 else lon2 end) * timeto) / nullif(timeto + timeto2, 0) else (lon * timeto2 + lon2 * timeto) / nullif(timeto + timeto2, 0) end as lon_c0,
    lat + speed * timeto / 60.0 / 60.0 * cos(radians(course)) / 60.0 as lat_a, lon + speed * timeto / 60.0 / 60.0 * sin(radians(course)) / (60.0 * cos(radians(lat))) as lon_a0,
    lat2 + speed2 * -timeto2 / 60.0 / 60.0 * cos(radians(course2)) / 60.0 as lat_b, lon2 + speed2 * -timeto2 / 60.0 / 60.0 * sin(radians(course2)) / (60.0 * cos(radians(lat2))) as lon_b0 from cnd),
pos2 as (select *, {near_sql('lon_c0')} as lon_c, {near_sql('lon_a0')} as lon_a, {near_sql('lon_b0')} as lon_b from pos),
lik as (select *, case when timeto2 > 3600 and timeto > 3600 then lat_c when timeto <= timeto2 or timeto2 is null then lat_a when timeto2 < timeto or timeto is null then lat_b end as likely_lat,
    case when timeto2 > 3600 and timeto > 3600 then lon_c when timeto <= timeto2 or timeto2 is null then lon_a when timeto2 < timeto or timeto is null then lon_b end as likely_lon from pos2
  where (lat_a between lat0 and lat1 and lon_a between lon0 and lon1) or (lat_b between lat0 and lat1 and lon_b between lon0 and lon1) or (lat_c between lat0 and lat1 and lon_c between lon0 and lon1))"""


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, IMAGES, SPANS, CAND, D1_SQL) + "select ssvid, scene_id, ts, ts2, round(likely_lat, 5) as likely_lat, round(likely_lon, 5) as likely_lon, coalesce(likely_lat between lat0 and lat1 and likely_lon between lon0 and lon1, false) as within_footprint from lik")
def d1_vessels_in_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Where a vessel likely was at a scene's instant: between pings if both are over an hour off, else reckoned from the nearer one."""
    c = _candidates(spark, d)
    t1, t2 = F.col("timeto"), F.col("timeto2")
    la, loa = geo.dead_reckon(F.col("lat"), F.col("lon"), F.col("course"), F.col("speed"), t1 / 60.0)
    lb, lob = geo.dead_reckon(F.col("lat2"), F.col("lon2"), F.col("course2"), F.col("speed2"), -t2 / 60.0)
    c = c.withColumns({"lat_c": safe_div(F.col("lat") * t2 + F.col("lat2") * t1, t1 + t2), "lon_c": geo.mean_lon(F.col("lon"), F.col("lon2"), t2, t1), "lat_a": la, "lon_a": geo.near_lon(loa), "lat_b": lb, "lon_b": geo.near_lon(lob)})
    inside = lambda y, x: F.coalesce(F.col(y).between(F.col("lat0"), F.col("lat1")) & F.col(x).between(F.col("lon0"), F.col("lon1")), F.lit(False))
    c = c.where(inside("lat_a", "lon_a") | inside("lat_b", "lon_b") | inside("lat_c", "lon_c"))
    pick = lambda k: F.when((t2 > 3600) & (t1 > 3600), F.col(f"{k}_c")).when((t1 <= t2) | t2.isNull(), F.col(f"{k}_a")).when((t2 < t1) | t1.isNull(), F.col(f"{k}_b"))
    c = c.withColumns({"likely_lat": pick("lat"), "likely_lon": pick("lon")})
    return c.select("ssvid", "scene_id", "ts", "ts2", F.round("likely_lat", 5).alias("likely_lat"), F.round("likely_lon", 5).alias("likely_lon"), inside("likely_lat", "likely_lon").alias("within_footprint"))
