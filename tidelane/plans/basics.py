"""Queries over single relational operators, as the domain's pipelines use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import bins, geo
from tidelane.functions.compat import bq_int, month_diff, safe_div, seconds_between, strict_greatest, strict_least, whole_days
from tidelane.plans import domain as D
from tidelane.plans.matching import LABEL_SQL, minutes_sql, near_sql, speed_sql
from tidelane.plans.registry import registry
from tidelane.runtime import read_table

QUERIES, SQL, query = registry()


# ---- scans, projection, filters ------------------------------------------------------------------------------------

@query("select ssvid, count(*) as pings from pipe_v20201001_5min where ping_date between date '2019-03-01' and date '2019-06-30' group by 1")
def s1_date_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """A range of day shards: a predicate on the date column, pushed to the scan."""
    return read_table(spark, d, "pipe_v20201001_5min").where("ping_date between date'2019-03-01' and date'2019-06-30'").groupBy("ssvid").agg(F.count(F.lit(1)).alias("pings"))


@query("select detect_id, detect_timestamp from detect_scene_match where detect_date between date '2019-06-14' - 1 and date '2019-06-14' + 1")
def s2_day_with_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "detect_scene_match").where("detect_date between date_sub(date'2019-06-14', 1) and date_add(date'2019-06-14', 1)").select("detect_id", "detect_timestamp")


@query("select * exclude (loaded_at, max_score, likelihood) from score_mult where not isnan(coalesce(score, 0))")
def sel_p1_all_except(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "score_mult").where("not isnan(coalesce(score, 0))").drop("loaded_at", "max_score", "likelihood")


@query("select distinct trim(scene_id) as scene_id, cast(detect_timestamp as date) as day from detect_scene_match")
def sel_p2_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "detect_scene_match").select(F.trim("scene_id").alias("scene_id"), F.to_date("detect_timestamp").alias("day")).distinct()


@query()
def sel_p7_readable_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Areas whose text can be read, with parts and corners."""
    from tidelane.operators.polygons import read_wkt
    import pandas as pd

    def sizes(batches):
        for pdf in batches:
            read = [(a, read_wkt(g)) for a, g in zip(pdf["area_id"], pdf["geometry"])]
            yield pd.DataFrame([(a, len(p), sum(len(r) for rings in p for r in rings)) for a, p in read if p], columns=["area_id", "parts", "corners"])

    return read_table(spark, d, "oil_areas").select("area_id", "geometry").mapInPandas(sizes, "area_id bigint, parts bigint, corners bigint").distinct()


@query(D.with_sql(D.DET, D.VESSEL) + "select detect_id, v.ssvid is not null as known, on_fishing_list is not null as listed from det left join vessel v using (ssvid)")
def sel_p8_flags_from_outer_join(spark: SparkSession, d: str) -> DataFrame:
    x = D.det(spark, d).join(D.vessel(spark, d).withColumn("hit", F.lit(True)), "ssvid", "left")
    return x.select("detect_id", F.col("hit").isNotNull().alias("known"), F.col("on_fishing_list").isNotNull().alias("listed"))


@query(D.with_sql(D.DET) + "select cast((lat_index + lon_index) % 2 + case when (lat_index + lon_index) % 2 < 0 then 2 else 0 end as bigint) as fold, count(*) as n from det group by 1")
def sel_p10_even_and_odd(spark: SparkSession, d: str) -> DataFrame:
    """Spatial halves of the data; sharding by hash (P9) is F.pmod(F.xxhash64(key), n)."""
    return D.det(spark, d).groupBy(F.pmod(F.col("lat_index") + F.col("lon_index"), F.lit(2)).cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins ---------------------------------------------------------------------------------------------------------

@query(D.with_sql(D.DET, D.VESSEL) + "select detect_id, ssvid, best_class, best_length_m from det join vessel using (ssvid)")
def j1_inner_using(spark: SparkSession, d: str) -> DataFrame:
    return D.det(spark, d).join(D.vessel(spark, d), "ssvid").select("detect_id", "ssvid", "best_class", "best_length_m")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderpriority, c_mktsegment, n_name, r_name, p_brand, s_name from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey")
def j2_left_lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    """A fact table with a chain of lookups; the fixed tables (nation, region) are broadcast, the others as their size decides."""
    t = lambda n: read_table(spark, d, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    x = x.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    x = x.join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderpriority", "c_mktsegment", "n_name", "r_name", "p_brand", "s_name")


@query(D.with_sql(D.DET, "lane as (select cast(floor(lat * 10) as bigint) as lat_bin, cast(floor(lon * 10) as bigint) as lon_bin, count(*) * 5 / 60.0::double as hours from pipe_v20201001_5min where abs(lat) <= 90 and abs(lon) <= 180 group by all)")
    + "select detect_id, round(coalesce(hours, 0), 6) as hours from det left join lane on cast(floor(lat * 10) as bigint) = lat_bin and cast(floor(lon * 10) as bigint) = lon_bin")
def d7_lane_density(spark: SparkSession, d: str) -> DataFrame:
    """Detections with the traffic of their tenth-degree cell: a join on computed keys."""
    p = read_table(spark, d, "pipe_v20201001_5min").where("abs(lat) <= 90 and abs(lon) <= 180 and not isnan(lat) and not isnan(lon)")
    lane = p.groupBy(geo.grid_index(F.col("lat"), 10).alias("lat_bin"), geo.grid_index(F.col("lon"), 10).alias("lon_bin")).agg((F.count(F.lit(1)) * 5 / 60.0).alias("hours"))
    x = D.det(spark, d).select("detect_id", geo.grid_index(F.col("lat"), 10).alias("lat_bin"), geo.grid_index(F.col("lon"), 10).alias("lon_bin"))
    return x.join(lane, ["lat_bin", "lon_bin"], "left").select("detect_id", F.round(F.coalesce("hours", F.lit(0.0)), 6).alias("hours"))


@query(D.with_sql(D.DET, D.INFRA_SQL) + "select lat_c, lon_c, count(*) as n from (select cast(round(lat) as bigint) as lat_c, cast(round(lon) as bigint) as lon_c from det) join (select distinct cast(round(lat) as bigint) as lat_c, cast(round(lon) as bigint) as lon_c from infra) using (lat_c, lon_c) group by all")
def j5_gridcode_join(spark: SparkSession, d: str) -> DataFrame:
    """Grid codes as whole numbers instead of text."""
    code = lambda x: x.select(bq_int(F.col("lat")).alias("lat_c"), bq_int(F.col("lon")).alias("lon_c"))
    return code(D.det(spark, d)).join(code(D.infra(spark, d)).distinct(), ["lat_c", "lon_c"]).groupBy("lat_c", "lon_c").agg(F.count(F.lit(1)).alias("n"))


@query(D.with_sql(D.DET, D.INFRA_SQL) + "select iso3, n, round(n / (sum(n) over ())::double, 8) as fraction from (select iso3, count(*) as n from infra group by 1)")
def j19_fraction_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = D.infra(spark, d).groupBy("iso3").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("iso3", "n", F.round(F.col("n") / F.col("total"), 8).alias("fraction"))


@query(D.with_sql(D.DET) + "select distinct scene_id from det where ssvid in (select trim(ssvid) from pipe_v20201001_5min where speed_knots between 3 and 6)")
def j22_semi_join(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pipe_v20201001_5min").where("speed_knots between 3 and 6").select(F.trim("ssvid").alias("ssvid"))
    return D.det(spark, d).join(p, "ssvid", "left_semi").select("scene_id").distinct()


@query(D.with_sql(D.PING, D.SIGHT, D.SIGHT_FOOT, "sat as (select scene_id, start_time as t, sat_lat0 as lat, sat_lon0 as lon from foot union all select scene_id, end_time, sat_lat1, sat_lon1 from foot)")
    + "select f.scene_id, substr(f.scene_id, 2, 4) as year, round(a.lat, 6) as start_lat, round(b.lat, 6) as end_lat from foot f join sat a on f.scene_id = a.scene_id and date_trunc('second', f.start_time) = date_trunc('second', a.t) join sat b on f.scene_id = b.scene_id and date_trunc('second', f.end_time) = date_trunc('second', b.t)")
def j24_position_at_second(spark: SparkSession, d: str) -> DataFrame:
    """Satellite positions at the very second a scene starts and ends."""
    f = D.sight_foot(spark, d)
    sat = f.select("scene_id", F.inline(F.array(F.struct(F.col("start_time").alias("t"), F.col("sat_lat0").alias("lat")), F.struct(F.col("end_time").alias("t"), F.col("sat_lat1").alias("lat"))))).withColumn("t", F.date_trunc("second", "t"))
    f = f.withColumns({"t0": F.date_trunc("second", "start_time"), "t1": F.date_trunc("second", "end_time")})
    x = f.join(sat.toDF("scene_id", "t0", "a"), ["scene_id", "t0"]).join(sat.toDF("scene_id", "t1", "b"), ["scene_id", "t1"])
    return x.select("scene_id", F.substring("scene_id", 2, 4).alias("year"), F.round("a", 6).alias("start_lat"), F.round("b", 6).alias("end_lat"))


@query(D.with_sql(D.DET) + "select a.detect_id as id_a, b.detect_id as id_b from det a join det b on cast(round(a.lat * 1e6) as bigint) = cast(round(b.lat * 1e6) as bigint) and cast(round(a.lon * 1e6) as bigint) = cast(round(b.lon * 1e6) as bigint) and a.detect_id < b.detect_id")
def j27_equal_positions(spark: SparkSession, d: str) -> DataFrame:
    """Equal positions as whole micro-degrees, never as doubles."""
    x = D.det(spark, d).select("detect_id", bq_int(F.col("lat") * 1e6).alias("y"), bq_int(F.col("lon") * 1e6).alias("x"))
    return x.toDF("id_a", "y", "x").join(x.toDF("id_b", "y", "x"), ["y", "x"]).where("id_a < id_b").select("id_a", "id_b")


# ---- aggregation, windows, order, sets, arrays ----------------------------------------------------------------------

@query("select n_regionkey, count(*) as customers, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 4) as mean, min(c_acctbal) as least, max(c_acctbal) as most, count(*) filter (c_acctbal < 0) as in_debt, round(sum(case when c_acctbal > 0 then c_acctbal else 0 end), 2) as credit, round(stddev_samp(c_acctbal), 4) as spread from customer join nation on c_nationkey = n_nationkey group by 1 having count(*) > 10")
def a1_grouped_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Plain (A1), conditional (A2) and deviation (A4) aggregates with a filter on one."""
    x = read_table(spark, d, "customer").join(F.broadcast(read_table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    b = F.col("c_acctbal")
    g = x.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(b), 2).alias("total"), F.round(F.avg(b), 4).alias("mean"), F.min(b).alias("least"), F.max(b).alias("most"), F.count_if(b < 0).alias("in_debt"), F.round(F.sum(F.when(b > 0, b).otherwise(0.0)), 2).alias("credit"), F.round(F.stddev_samp(b), 4).alias("spread"))
    return g.where("customers > 10")


@query("select user_id, round(avg(n), 6) as mean_per_day, max(n) as most, round(stddev_samp(v), 6) as spread from (select user_id, cast(ts as date) as day, count(*) as n, avg(value) as v from events group by all) group by 1")
def a5_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """By day, then over all days."""
    g = read_table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return g.groupBy("user_id").agg(F.round(F.avg("n"), 6).alias("mean_per_day"), F.max("n").alias("most"), F.round(F.stddev_samp("v"), 6).alias("spread"))


@query(D.with_sql(D.PING, D.VESSEL) + "select lat_bin, lon_bin, round(sum(h), 6) as hours, round(sum(case when on_fishing_list then h else 0 end), 6) as fishing_hours, round(sum(h) / (111.0::double * 111.0::double / 100 * cos(radians(lat_bin / 10.0::double))), 8) as per_km2 from (select cast(floor(lat * 10) as bigint) as lat_bin, cast(floor(lon * 10) as bigint) as lon_bin, 5 / 60.0::double as h, ssvid from ping) left join vessel using (ssvid) group by lat_bin, lon_bin")
def a18_hours_grid(spark: SparkSession, d: str) -> DataFrame:
    x = D.ping(spark, d).select(geo.grid_index(F.col("lat"), 10).alias("lat_bin"), geo.grid_index(F.col("lon"), 10).alias("lon_bin"), "ssvid").join(D.vessel(spark, d), "ssvid", "left")
    h = F.lit(5 / 60.0)
    g = x.groupBy("lat_bin", "lon_bin").agg(F.sum(h).alias("s"), F.round(F.sum(F.when(F.col("on_fishing_list"), h).otherwise(0.0)), 6).alias("fishing_hours"))
    return g.select("lat_bin", "lon_bin", F.round("s", 6).alias("hours"), "fishing_hours", F.round(F.col("s") / geo.cell_area_km2(F.col("lat_bin") / 10.0, 10), 8).alias("per_km2"))


@query("select r_name, round(sum(h), 2) as hours, round(sum(h) / sum(sum(h)) over (), 8) as fraction from (select n_name, sum(l_quantity) as h from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1) join nation using (n_name) join region on n_regionkey = r_regionkey group by 1")
def a21_hours_by_continent(spark: SparkSession, d: str) -> DataFrame:
    """Country totals, looked up to continents (F29), as fractions."""
    t = lambda n: read_table(spark, d, n)
    nation = F.broadcast(t("nation"))
    c = t("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("h")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("h").alias("h"))
    g = c.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("h").alias("s"))
    return g.join(F.broadcast(g.agg(F.sum("s").alias("all")))).select("r_name", F.round("s", 2).alias("hours"), F.round(F.col("s") / F.col("all"), 8).alias("fraction"))


@query("select scene_id, ssvid, detect_id, loaded_at from (select *, row_number() over (partition by scene_id, ssvid, detect_id order by loaded_at desc, score desc nulls last) as k from score_mult) where k = 1")
def w4_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each key by a fixed order instead of a random one, as an aggregate."""
    return read_table(spark, d, "score_mult").groupBy("scene_id", "ssvid", "detect_id").agg(F.max("loaded_at").alias("loaded_at"))


@query("select l_partkey, l_suppkey, q, round(cum / total, 8) as share from (select *, sum(q) over (partition by l_suppkey order by q desc, l_partkey rows unbounded preceding) as cum, sum(q) over (partition by l_suppkey) as total from (select l_partkey, l_suppkey, sum(l_quantity) as q from lineitem group by all))")
def w12_cumulative_share(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("l_partkey", "l_suppkey", "q", F.round(F.sum("q").over(w) / F.sum("q").over(Window.partitionBy("l_suppkey")), 8).alias("share"))


@query("select o_orderpriority, o_orderstatus, o_orderkey from orders order by o_orderpriority, o_orderstatus desc, o_orderkey")
def t1_order_by(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey").orderBy("o_orderpriority", F.desc("o_orderstatus"), "o_orderkey")


@query(D.with_sql(D.INFRA_SQL) + "select iso3, n from (select iso3, count(*) as n from infra group by 1) order by n desc, iso3 limit 10")
def t2_top_countries(spark: SparkSession, d: str) -> DataFrame:
    """The ten countries with most structures."""
    return D.infra(spark, d).groupBy("iso3").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "iso3").limit(10)


@query(D.with_sql(D.DET) + "select scene_id from (select distinct scene_id from det) order by ('0x' || substr(md5('5:' || scene_id), 1, 8))::ubigint nulls first, scene_id limit 40")
def t3_random_subset(spark: SparkSession, d: str) -> DataFrame:
    """Forty scenes by a reproducible draw."""
    x = D.det(spark, d).select("scene_id").distinct()
    return x.orderBy(bins.uniform(F.col("scene_id"), 5), "scene_id").limit(40)


@query("select scene_id, ssvid, detect_id, case when not isnan(score) then score end as score, null::double as confidence from score_mult union all select scene_id, ssvid, detect_id, case when not isnan(score) then score end, case when not isnan(confidence) then confidence end from detect_scene_match")
def u1_union_all(spark: SparkSession, d: str) -> DataFrame:
    """Positions by name, missing columns null; numbers that are none become null."""
    a, b = read_table(spark, d, "score_mult").select("scene_id", "ssvid", "detect_id", "score"), read_table(spark, d, "detect_scene_match").select("scene_id", "ssvid", "detect_id", "score", "confidence")
    return a.unionByName(b, allowMissingColumns=True).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("score", "confidence")})


@query("select scene_id from score_mult union select scene_id from detect_scene_match")
def u3_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "score_mult").select("scene_id").union(read_table(spark, d, "detect_scene_match").select("scene_id")).distinct()


@query(D.with_sql(D.INFRA_SQL) + "select id, cast(unnest(generate_series(m, (m + interval 2 month)::date, interval 1 month)) as date) as month from (select id, cast(date_trunc('month', midpoint) as date) as m from infra where midpoint is not null)")
def ar3_month_array(spark: SparkSession, d: str) -> DataFrame:
    m = F.trunc("midpoint", "month")
    return D.infra(spark, d).where("midpoint is not null").select("id", F.explode(F.sequence(m, F.add_months(m, 2), F.expr("interval 1 month"))).alias("month"))


@query("select cast(unnest(generate_series(timestamp '2017-01-01', timestamp '2017-12-31', interval 24 day)) as timestamp) as period")
def ar4_timestamp_array(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr("sequence(timestamp'2017-01-01', timestamp'2017-12-31', interval 24 day)")).alias("period"))


@query(f"select id, coalesce(iso_ter1[1], 'none') as first, coalesce(len(iso_ter1), 0) as n from (select distinct id, iso_ter1 from {D.INFRA})")
def ar5_array_element(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, D.INFRA).select("id", "iso_ter1").distinct()
    n = F.coalesce(F.when(F.col("iso_ter1").isNotNull(), F.size("iso_ter1")), F.lit(0)).cast("bigint")
    return x.select("id", F.coalesce(F.get("iso_ter1", F.lit(0)), F.lit("none")).alias("first"), n.alias("n"))


@query("select x as min_lon, y as min_lat, x + 20 as max_lon, y + 20 as max_lat from (select unnest(range(-180, 180, 20)) as x), (select unnest(range(-80, 80, 20)) as y)")
def d48_tile_grid(spark: SparkSession, d: str) -> DataFrame:
    from tidelane.functions.ranges import tile_grid

    return tile_grid(spark, -180, -80, 180, 80, 20)


# ---- scalar functions ----------------------------------------------------------------------------------------------

@query("select s_suppkey, coalesce(nullif(s_nationkey, 0), -1) as nation, case when s_acctbal > 0 then 'credit' when s_acctbal < 0 then 'debt' else 'none' end as kind, round(s_acctbal / nullif(s_nationkey, 0), 6) as ratio, cast(round(s_acctbal / 4) as bigint) as quarter, case when nullif(s_nationkey, 3) is not null then greatest(s_suppkey, s_nationkey) end as top, case when nullif(s_nationkey, 3) is not null then least(s_suppkey, s_nationkey) end as low from supplier")
def f1_null_and_rounding_rules(spark: SparkSession, d: str) -> DataFrame:
    """Conditionals (F1), safe division (F2), rounding casts, null-strict extremes."""
    n = F.col("s_nationkey").cast("bigint")
    strict = F.nullif(n, F.lit(3).cast("bigint"))
    keep = lambda f: F.when(f(F.col("s_suppkey"), strict).isNotNull(), f(F.col("s_suppkey"), strict))
    return read_table(spark, d, "supplier").select(
        "s_suppkey", F.coalesce(F.nullif("s_nationkey", F.lit(0)), F.lit(-1)).alias("nation"), F.when(F.col("s_acctbal") > 0, "credit").when(F.col("s_acctbal") < 0, "debt").otherwise("none").alias("kind"),
        F.round(safe_div(F.col("s_acctbal"), n), 6).alias("ratio"), bq_int(F.col("s_acctbal") / 4).alias("quarter"), keep(strict_greatest).alias("top"), keep(strict_least).alias("low"),
    )


@query("select event_id, round(floor(value) + abs(value - 50), 6) as a, round(pow(value / 100, 2) + sqrt(value), 6) as b, round(sin(value) + cos(value), 6) as c, round(atan2(value - 50, 10), 6) as t, round(ln(1 + value), 6) as l from events where value >= 0")
def f3_mathematics(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return read_table(spark, d, "events").where("value >= 0").select("event_id", F.round(F.floor(v) + F.abs(v - 50), 6).alias("a"), F.round(F.pow(v / 100, 2) + F.sqrt(v), 6).alias("b"), F.round(F.sin(v) + F.cos(v), 6).alias("c"), F.round(F.atan2(v - 50, F.lit(10.0)), 6).alias("t"), F.round(F.log1p(v), 6).alias("l"))


@query("select p_partkey, p_brand || '/' || cast(p_size as varchar) as code, upper(substr(p_name, 1, 5)) as head, length(p_name) as n, regexp_matches(p_type, '(STEEL|BRASS|steel|brass)$') as metal from part")
def f5_text(spark: SparkSession, d: str) -> DataFrame:
    """Text functions and regular expressions."""
    return read_table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("code"), F.upper(F.substring("p_name", 1, 5)).alias("head"), F.length("p_name").cast("bigint").alias("n"), F.col("p_type").rlike("(STEEL|BRASS|steel|brass)$").alias("metal"))


@query(D.with_sql(D.DET) + "select detect_id, try_strptime(nullif(regexp_extract(scene_id, '_(\\d{8}T\\d{6})_(\\d{8}T\\d{6})_', 1), ''), '%Y%m%dT%H%M%S') as start_time, substr(scene_id, 3, 1) as satellite from det")
def f6_scene_times(spark: SparkSession, d: str) -> DataFrame:
    return D.det(spark, d).select("detect_id", bins.scene_time(F.col("scene_id"), 1).alias("start_time"), F.substring("scene_id", 3, 1).alias("satellite"))


@query(D.with_sql(D.DET) + "select detect_id, strftime(ts, '%Y%m%d') as day_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') as time_text, printf('%+04d', cast(round(lat) as bigint)) as lat_text from det")
def f7_formats(spark: SparkSession, d: str) -> DataFrame:
    return D.det(spark, d).select("detect_id", F.date_format("ts", "yyyyMMdd").alias("day_text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time_text"), F.format_string("%+04d", bq_int(F.col("lat"))).alias("lat_text"))


@query("""select o_orderkey, cast(extract(year from o_orderdate) as integer) as y, cast(extract(month from o_orderdate) as integer) as m, cast(extract(day from o_orderdate) as integer) as dd, cast(extract(doy from o_orderdate) as integer) as doy, cast(date_trunc('month', o_orderdate) as date) as month,
  cast(o_orderdate as date) + 10 as later, cast((2001 - extract(year from o_orderdate)) * 12 + 8 - extract(month from o_orderdate) as bigint) as months, cast(trunc((epoch_us(timestamp '2001-08-01 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0::double) as bigint) as days,
  cast(extract(year from o_orderdate) * 10 + floor(extract(doy from o_orderdate) / 366.5 * 4) as bigint) as quarter, cast(date '2017-01-01' + cast(floor((cast(o_orderdate as date) - date '2017-01-01') / 24.0) * 24 as integer) as date) as period from orders""")
def f8_dates(spark: SparkSession, d: str) -> DataFrame:
    """Parts (F8), differences (F9), 24-day periods (F10) and quarters by day of year."""
    t = F.col("o_orderdate").cast("timestamp")
    end = F.expr("timestamp'2001-08-01 12:00:00'")
    return read_table(spark, d, "orders").select(
        "o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("dd"), F.dayofyear(t).alias("doy"), F.trunc(t.cast("date"), "month").alias("month"), F.date_add(t.cast("date"), 10).alias("later"),
        month_diff(t, end).alias("months"), whole_days(t, end).alias("days"), bins.pseudo_quarter(t).alias("quarter"), bins.period24(t).alias("period"),
    )


@query("select ext_id, extrap_timestamp + (loaded_at - extrap_timestamp) / 2 as middle, cast(trunc((epoch_us(loaded_at) - epoch_us(extrap_timestamp)) / 1e6) as bigint) as seconds from detect_foot_ext_doppler")
def f9_midpoint_time(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.unix_micros("extrap_timestamp"), F.unix_micros("loaded_at")
    return read_table(spark, d, "detect_foot_ext_doppler").select("ext_id", F.timestamp_micros(a + F.floor((b - a) / 2)).alias("middle"), seconds_between(F.col("extrap_timestamp"), F.col("loaded_at")).alias("seconds"))


@query(D.with_sql(D.VESSEL) + f"select ext_id, {speed_sql('speed1')} as speed_lower, {minutes_sql('delta_minutes1')} as minutes_lower, {LABEL_SQL} as label from detect_foot_ext_doppler e left join vessel v on trim(e.ssvid) = v.ssvid")
def f14_step_maps(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "detect_foot_ext_doppler").withColumn("ssvid", F.trim("ssvid")).join(D.vessel(spark, d), "ssvid", "left")
    return e.select("ext_id", bins.speed_bin(F.col("speed1")).alias("speed_lower"), bins.minutes_bin(F.col("delta_minutes1")).alias("minutes_lower"), bins.vessel_label(F.col("best_class")).alias("label"))


@query(f"select ext_id, round({near_sql('x')}, 6) as lon from (select ext_id, lon_extrapolate1 + 2 * lon_doppler_offset * 1000 as x from detect_foot_ext_doppler)")
def f16_near_longitude(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "detect_foot_ext_doppler").select("ext_id", F.round(geo.near_lon(F.col("lon_extrapolate1") + 2 * F.col("lon_doppler_offset") * 1000), 6).alias("lon"))


@query("""select ext_id, round(q1 * (1 - x) * (1 - y) + q2 * x * (1 - y) + q3 * (1 - x) * y + q4 * x * y, 6) as v, round(degrees(atan2(g, 700000.0)) * case when is_single then -1 else 1 end, 6) as look_angle from (
  select ext_id, is_single, delta_minutes1 as q1, delta_minutes2 as q2, speed1 as q3, speed2 as q4, abs(lat_extrapolate1) % 1 as x, abs(lon_extrapolate1) % 1 as y, abs(lat_extrapolate1) * 10000 as g from detect_foot_ext_doppler)""")
def f22_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Bilinear interpolation, and the look angle."""
    one, zero = F.lit(1.0), F.lit(0.0)
    x, y = F.abs("lat_extrapolate1") % 1, F.abs("lon_extrapolate1") % 1
    v = geo.bilinear(F.col("delta_minutes1"), F.col("speed1"), F.col("delta_minutes2"), F.col("speed2"), zero, one, zero, one, x, y)
    g = F.abs("lat_extrapolate1") * 10000
    return read_table(spark, d, "detect_foot_ext_doppler").select("ext_id", F.round(v, 6).alias("v"), F.round(geo.look_angle_deg(g, F.lit(700000.0), F.coalesce("is_single", F.lit(False))), 6).alias("look_angle"))


@query(D.with_sql(D.DET) + f"select a.detect_id, b.detect_id as other, round({D.hav_sql('a', 'b')}, 2) as meters, round(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + case when degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) < 0 then 360 else 0 end, 6) as bearing from det a join det b on a.scene_id = b.scene_id and a.detect_id < b.detect_id")
def f24_distance_and_bearing(spark: SparkSession, d: str) -> DataFrame:
    a = D.det(spark, d).select("detect_id", "scene_id", "lat", "lon")
    x = a.join(a.toDF("other", "scene_id", "lat2", "lon2"), "scene_id").where("detect_id < other")
    p = (F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return x.select("detect_id", "other", F.round(geo.haversine_m(*p), 2).alias("meters"), F.round(geo.bearing_deg(*p), 6).alias("bearing"))


@query(D.with_sql(D.DET) + "select cast(floor(lat * 200) as bigint) as y, cast(floor(lon * 200) as bigint) as x, count(*) as n from det group by all")
def f25_grid_cell(spark: SparkSession, d: str) -> DataFrame:
    """Square cells stand in for hexagons."""
    return D.det(spark, d).groupBy(geo.grid_index(F.col("lat"), 200).alias("y"), geo.grid_index(F.col("lon"), 200).alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query(D.with_sql(D.DET) + "select detect_id, scene_id || ';' || rpad(printf('%.6f', round(lon, 6)), 11, '0') || ';' || rpad(printf('%.6f', round(lat, 6)), 10, '0') as made from det where scene_id is not null")
def f26_detect_id_text(spark: SparkSession, d: str) -> DataFrame:
    return D.det(spark, d).where("scene_id is not null").select("detect_id", bins.detect_id_text(F.col("scene_id"), F.round("lon", 6), F.round("lat", 6)).alias("made"))
