"""Queries over offshore structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import bins
from tidelane.operators import clusters as C
from tidelane.operators.polygons import areas_holding
from tidelane.operators.proximity import distance_join
from tidelane.plans import domain as D
from tidelane.plans.registry import registry
from tidelane.runtime import read_table

QUERIES, SQL, query = registry()

CLASSES = ("wind", "oil", "other", "noise")
LABEL = "case when wind is null or oil is null or other is null or noise is null then null when wind = greatest(wind, oil, other, noise) then 'wind' when oil = greatest(wind, oil, other, noise) then 'oil' when other = greatest(wind, oil, other, noise) then 'other' else 'noise' end"


def near_sql(radius: str, op: str = "<") -> str:
    """Pairs (a, b) of different structures within a radius, by latitude bands both must share."""
    return f"""nr as (select a.id as a, b.id as b from (select *, floor(lat * 20) as band from infra) a join (select *, floor(lat * 20) + o as band from infra, (values (-1), (0), (1)) as s(o)) b
    on a.band = b.band and a.id <> b.id and abs(a.lat - b.lat) < 0.02 where {D.hav_sql('a', 'b')} {op} {radius})"""


REACH = "rch as (select id as a, id as b from infra union select r.a, n.b from rch r join nr n on r.b = n.a), cmp as (select a as id, min(b) as cluster from rch group by 1)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return D.infra(spark, d).select("id", "lat", "lon")


@query("with recursive " + D.INFRA_SQL + ",\n" + near_sql("50") + ",\n" + REACH + "\nselect * from cmp")
def d33_dbscan_components(spark: SparkSession, d: str) -> DataFrame:
    """DBSCAN of 50 m where one point suffices: components of near pairs."""
    return C.dbscan(_points(spark, d), 50.0, 1)


@query("with recursive " + D.INFRA_SQL + ",\n" + near_sql("100") + ",\n" + REACH + ",\nsz as (select cluster, count(*) as n from cmp group by 1)\nselect id, case when n >= 2 then cluster end as cluster from cmp join sz using (cluster)")
def d34_dbscan_pairs(spark: SparkSession, d: str) -> DataFrame:
    """DBSCAN of 100 m with two points at least; lone points are noise."""
    return C.dbscan(_points(spark, d), 100.0, 2)


@query("with recursive " + D.INFRA_SQL + ",\n" + near_sql("100") + """,
cr as (select a as id from nr group by 1 having count(*) >= 2),
rch as (select id as a, id as b from cr union select r.a, n.b from rch r join nr n on r.b = n.a join cr on n.b = cr.id),
cc as (select a as id, min(b) as cluster from rch group by 1)
select i.id, coalesce(cc.cluster, e.reach) as cluster from infra i left join cc using (id) left join (select n.a as id, min(cluster) as reach from nr n join cc on n.b = cc.id group by 1) e using (id)""")
def d34_dbscan_three(spark: SparkSession, d: str) -> DataFrame:
    return C.dbscan(_points(spark, d), 100.0, 3)


CENTRE = "cen as (select cluster, degrees(atan2(z, sqrt(x * x + y * y))) as lat, degrees(atan2(y, x)) as lon from (select cluster, avg(cos(radians(lat)) * cos(radians(lon))) as x, avg(cos(radians(lat)) * sin(radians(lon))) as y, avg(sin(radians(lat))) as z from cmp join infra using (id) group by 1))"


@query("with recursive " + D.INFRA_SQL + ",\n" + near_sql("50") + ",\n" + REACH + ",\n" + CENTRE + "\nselect cluster, round(lat, 6) as lat, round(lon, 6) as lon from cen")
def a22_cluster_centres(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    c = C.centroids(p.join(C.dbscan(p, 50.0, 1), "id"), "cluster")
    return c.select("cluster", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("with recursive " + D.INFRA_SQL + ",\n" + near_sql("50") + ",\n" + REACH + ",\n" + CENTRE + f""",
q as (select i.id, c.cluster, {D.hav_sql('i', 'c')} as m from (select *, floor(lat * 20) as band from infra) i join (select *, floor(lat * 20) + o as band from cen, (values (-1), (0), (1)) as s(o)) c on i.band = c.band and abs(i.lat - c.lat) < 0.02)
select id, cluster, round(m, 3) as distance_m from (select *, row_number() over (partition by id order by m, cluster) as k from q where m <= 100) where k = 1""")
def j13_nearest_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Each structure with the nearest cluster centre within 100 m."""
    p = _points(spark, d)
    c, _ = _written(C.centroids(p.join(C.dbscan(p, 50.0, 1), "id"), "cluster"))
    n = C.nearest(p, c, 100.0, "id", "cluster")
    return n.select("id", F.col("r_cluster").alias("cluster"), F.round("distance_m", 3).alias("distance_m"))


def _written(df: DataFrame):
    from tidelane.runtime import written

    return written(df, "plan")


@query(D.with_sql(D.INFRA_SQL, D.DET) + f"""select detect_id, count(*) as structures, count(*) filter (m < 2000) as within_2km from (
  select d.detect_id, {D.hav_sql('d', 'i')} as m from (select *, floor(lat * 5) as band from det) d join (select *, floor(lat * 5) + o as band from infra, (values (-1), (0), (1)) as s(o)) i on d.band = i.band and abs(d.lat - i.lat) < 0.1) where m <= 10000 group by 1""")
def j7_close_to_infrastructure(spark: SparkSession, d: str) -> DataFrame:
    met = distance_join(D.det(spark, d).select("detect_id", "lat", "lon"), D.infra(spark, d).select("id", "lat", "lon"), 10_000.0)
    return met.groupBy("detect_id").agg(F.count(F.lit(1)).alias("structures"), F.count_if(F.col("distance_m") < 2000).alias("within_2km"))


COMP = "cmpo as (select distinct l_partkey as cluster, cast(date_trunc('month', l_shipdate) as date) as midpoint from lineitem)"


def composites(spark: SparkSession, d: str) -> DataFrame:
    """Months in which a cluster was seen, from order lines."""
    return read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("cluster"), F.trunc(F.to_date("l_shipdate"), "month").alias("midpoint")).distinct()


@query(D.with_sql(COMP, """gp as (select *, case when lag(midpoint) over w is null or (extract(year from midpoint) - extract(year from lag(midpoint) over w)) * 12 + extract(month from midpoint) - extract(month from lag(midpoint) over w) > 2 then 1 else 0 end as new from cmpo window w as (partition by cluster order by midpoint)),
sb as (select *, sum(new) over (partition by cluster order by midpoint rows unbounded preceding) as subcluster from gp),
rg as (select cluster, subcluster, min(midpoint) as sub_start, max(midpoint) as sub_end from sb group by all having count(*) >= 2),
ev as (select *, min(sub_start) over (partition by cluster) as cluster_start, max(sub_end) over (partition by cluster) as cluster_end, cast(unnest(generate_series(sub_start, sub_end, interval 1 month)) as date) as midpoint from rg)""")
    + "select e.cluster, cast(e.subcluster as bigint) as subcluster, e.midpoint, s.midpoint is not null as seen, cluster_start, cluster_end, sub_start, sub_end from ev e left join cmpo s on e.cluster = s.cluster and e.midpoint = s.midpoint")
def d35_cluster_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by gaps of months (W7), single months dropped (W8), starts and ends (W5), months filled in (AR3)."""
    return C.lifetimes(composites(spark, d), "cluster", "midpoint")


@query(D.with_sql(COMP) + "select cluster, midpoint, first_value(midpoint) over w as cluster_start, last_value(midpoint) over w as cluster_end, count(*) over (partition by cluster) as n from cmpo window w as (partition by cluster order by midpoint rows between unbounded preceding and unbounded following)")
def w5_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cluster")
    return composites(spark, d).select("cluster", "midpoint", F.min("midpoint").over(w).alias("cluster_start"), F.max("midpoint").over(w).alias("cluster_end"), F.count(F.lit(1)).over(w).alias("n"))


@query(D.with_sql(D.INFRA_SQL) + "select id, first_value(length_m ignore nulls) over (partition by iso3 order by id rows between unbounded preceding and unbounded following) as first_known, coalesce(length_m, lag(length_m) over (partition by iso3 order by id)) as carried from infra where not isnan(coalesce(length_m, 0))")
def w6_fill_within_group(spark: SparkSession, d: str) -> DataFrame:
    """First known value of the group (an aggregate), and one-step carry."""
    x = D.infra(spark, d).where(~F.isnan(F.coalesce("length_m", F.lit(0.0))))
    first = x.where("length_m is not null").groupBy("iso3").agg(F.min_by("length_m", "id").alias("first_known"))
    w = Window.partitionBy("iso3").orderBy("id")
    carried = x.select("id", "iso3", F.coalesce("length_m", F.lag("length_m").over(w)).alias("carried"))
    return carried.join(F.broadcast(first), "iso3", "left").select("id", "first_known", "carried")


@query(D.with_sql(D.INFRA_SQL) + f"select id, {LABEL} as label from infra")
def a10_top_label(spark: SparkSession, d: str) -> DataFrame:
    return D.infra(spark, d).select("id", C.top_label(*CLASSES).alias("label"))


AVG = f"av as (select lat_bin, lon_bin, wind, oil, other, noise, {LABEL} as label from (select cast(floor(lat * 2) as bigint) as lat_bin, cast(floor(lon * 2) as bigint) as lon_bin, round(avg(wind), 9) as wind, round(avg(oil), 9) as oil, round(avg(other), 9) as other, round(avg(noise), 9) as noise from infra group by all))"


@query(D.with_sql(D.INFRA_SQL, AVG) + "select lat_bin, lon_bin, label from av")
def d39_averaged_labels(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of a cell, then the class with the largest."""
    x = D.infra(spark, d).select(F.floor(F.col("lat") * 2).cast("bigint").alias("lat_bin"), F.floor(F.col("lon") * 2).cast("bigint").alias("lon_bin"), *CLASSES)
    g = x.groupBy("lat_bin", "lon_bin").agg(*[F.round(F.avg(c), 9).alias(c) for c in CLASSES])
    return g.select("lat_bin", "lon_bin", C.top_label(*CLASSES).alias("label"))


AMBIGUOUS = "coalesce(len(by_angle) > 1 and len(list_filter(by_angle, lambda a: a.overpasses > 5 and a.detections::double / a.overpasses > 0.9)) > 0 and len(list_filter(by_angle, lambda a: a.overpasses > 5 and a.detections::double / a.overpasses < 0.1)) > 0, false)"


@query(D.with_sql(D.INFRA_SQL) + f"select id, {AMBIGUOUS} as possible_ambiguity, coalesce(len(by_angle), 0) as angles from infra")
def ar6_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return D.infra(spark, d).select("id", C.ambiguous("by_angle").alias("possible_ambiguity"), F.coalesce(F.when(F.col("by_angle").isNotNull(), F.size("by_angle")), F.lit(0)).cast("bigint").alias("angles"))


@query(D.with_sql(D.INFRA_SQL) + "select id, a.look_angle, a.overpasses, a.detections from (select id, unnest(by_angle) as a from infra) where a is not null")
def ar1_unnest(spark: SparkSession, d: str) -> DataFrame:
    return D.infra(spark, d).select("id", F.explode("by_angle").alias("a")).where("a is not null").select("id", "a.*")


@query(D.with_sql(D.INFRA_SQL) + "select iso3, array_to_string(list(id order by id), ',') as ids, array_to_string(list(coalesce(len(by_angle), 0) order by id), ',') as angles from infra group by 1")
def a7_array_agg(spark: SparkSession, d: str) -> DataFrame:
    """Arrays in a fixed order. Groups are countries; for output of unbounded groups write rows instead."""
    n = F.coalesce(F.when(F.col("by_angle").isNotNull(), F.size("by_angle")), F.lit(0)).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("id", n.alias("a"))))
    return D.infra(spark, d).groupBy("iso3").agg(rows.alias("r")).select("iso3", F.array_join(F.col("r.id").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("r.a").cast("array<string>"), ",").alias("angles"))


@query(D.with_sql(D.INFRA_SQL) + "select iso3, month, round(median(length_m), 6) as median_m, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by month), 4) as pct from (select iso3, midpoint as month, length_m from infra where length_m is not null and not isnan(length_m) and midpoint is not null) group by iso3, month")
def a8_median_by_country(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians (A8) and percent of the month's total."""
    x = D.infra(spark, d).where("length_m is not null and not isnan(length_m) and midpoint is not null")
    g = x.groupBy("iso3", F.col("midpoint").alias("month")).agg(F.round(F.median("length_m"), 6).alias("median_m"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("month")), 4))


@query(D.with_sql(D.INFRA_SQL) + "select distinct iso3, round(quantile_cont(length_m, 0.5) over (partition by iso3), 6) as median_m from infra where length_m is not null and not isnan(length_m)")
def w10_window_percentile(spark: SparkSession, d: str) -> DataFrame:
    x = D.infra(spark, d).where("length_m is not null and not isnan(length_m)")
    return x.select("iso3", F.round(F.percentile("length_m", F.lit(0.5)).over(Window.partitionBy("iso3")), 6).alias("median_m")).distinct()


@query(D.with_sql(D.INFRA_SQL) + "select id, dense_rank() over (order by iso3) as country_number from infra")
def w11_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers by rank of a key: only the distinct keys are ordered."""
    x = D.infra(spark, d)
    numbers = x.select("iso3").distinct().withColumn("country_number", F.dense_rank().over(Window.orderBy("iso3")))
    return x.join(F.broadcast(numbers), "iso3").select("id", F.col("country_number"))


@query(D.with_sql(D.INFRA_SQL) + "select lat_bin, first_iso3, iso3 from (select cast(floor(lat) as bigint) as lat_bin, first_value(iso3) over (partition by cast(floor(lat) as bigint) order by id) as first_iso3, iso3 from infra) group by all")
def w14_first_by_order(spark: SparkSession, d: str) -> DataFrame:
    x = D.infra(spark, d).withColumn("lat_bin", F.floor("lat").cast("bigint"))
    first = x.groupBy("lat_bin").agg(F.min_by("iso3", "id").alias("first_iso3"))
    return x.select("lat_bin", "iso3").distinct().join(first, "lat_bin").select("lat_bin", "first_iso3", "iso3")


RELABEL = f"rl as (select id, lat, lon, case when wind > 0.95 then 'wind' when noise > 0.9 and oil < 0.5 then 'noise' when oil > 0.8 and detections > 10 then 'oil' when presence < 0.3 then 'unknown' when {LABEL} = 'wind' then 'possible_wind' else {LABEL} end as label from infra)"


def _rules(x: DataFrame) -> DataFrame:
    top = C.top_label(*CLASSES)
    rules = [(F.expr("wind > 0.95"), "wind"), (F.expr("noise > 0.9 and oil < 0.5"), "noise"), (F.expr("oil > 0.8 and detections > 10"), "oil"), (F.expr("presence < 0.3"), "unknown"), (top == "wind", "possible_wind"), (top == "oil", "oil"), (top == "other", "other"), (top == "noise", "noise")]
    return x.select("id", "lat", "lon", C.relabel(x, rules, "unknown").alias("label"))


def _hop(k: int) -> str:
    return f"""h{k} as (select id, lat, lon, case when label = 'possible_wind' and exists (select 1 from (select *, floor(lat * 20) + o as band from h{k - 1}, (values (-1), (0), (1)) as s(o) where label = 'wind') w
    where w.band = floor(h.lat * 20) and {D.hav_sql('h', 'w')} <= 2000) then 'wind' else label end as label from h{k - 1} h)"""


@query(D.with_sql(D.INFRA_SQL, RELABEL, "h0 as (select * from rl)", _hop(1), _hop(2), _hop(3)) + "select id, label from h3")
def d36_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Labels by rules in order, then three hops of 2 km from wind farms to likely turbines."""
    return C.spread_label(_rules(D.infra(spark, d)), "id", "label", "wind", "possible_wind", 2000.0).select("id", "label")


@query("with recursive " + D.INFRA_SQL + ",\n" + near_sql("100") + ",\n" + REACH + """,
ob as (select c.cluster, i.midpoint, count(*) as seen, sum(i.detections) as detections from cmp c join infra i using (id) where i.midpoint is not null group by all)
select cluster, midpoint, seen, cast(detections as bigint) as detections, cast(sum(detections) over (partition by cluster order by midpoint) as bigint) as so_far from ob""")
def d37_repeat_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that recur at one place: how often in each half year and so far."""
    x = D.infra(spark, d).where("midpoint is not null")
    c = C.dbscan(_points(spark, d), 100.0, 1)
    g = x.join(c, "id").groupBy("cluster", "midpoint").agg(F.count(F.lit(1)).alias("seen"), F.sum("detections").alias("detections"))
    return g.withColumn("so_far", F.sum("detections").over(Window.partitionBy("cluster").orderBy("midpoint")))


def _inside(spark: SparkSession, d: str) -> DataFrame:
    return areas_holding(D.infra(spark, d), read_table(spark, d, "oil_areas"), "id", "lat", "lon", "area_id", "geometry")


HELD = D.held_sql("infra", "id")


@query(D.with_sql(D.INFRA_SQL, HELD) + "select point as id, cast(area_id as varchar) as area_id from held")
def j9_structures_in_areas(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, d).select(F.col("point").cast("bigint").alias("id"), F.col("area").alias("area_id"))


@query(D.with_sql(D.INFRA_SQL, HELD) + f"select id, iso3, {AMBIGUOUS} as possible_ambiguity, coalesce(areas, '') as areas from infra left join (select point as id, string_agg(cast(area_id as varchar), ',' order by cast(area_id as varchar)) as areas from held group by 1) using (id)")
def d38_ambiguity_with_areas(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous structures with the areas that hold them, in order."""
    held = _inside(spark, d).groupBy(F.col("point").cast("bigint").alias("id")).agg(F.concat_ws(",", F.sort_array(F.collect_list("area"))).alias("areas"))
    x = D.infra(spark, d).select("id", "iso3", C.ambiguous("by_angle").alias("possible_ambiguity"))
    return x.join(held, "id", "left").withColumn("areas", F.coalesce("areas", F.lit("")))


@query(D.with_sql(D.INFRA_SQL, HELD) + f"select case when id in (select point from held) then 'inside' else 'outside' end as place, {LABEL} as label, count(*) as n from infra group by all")
def u2_inside_and_outside(spark: SparkSession, d: str) -> DataFrame:
    """Counts of structures in and out of areas by label."""
    held = _inside(spark, d).select(F.col("point").cast("bigint").alias("id")).distinct().withColumn("where", F.lit("inside"))
    x = D.infra(spark, d).select("id", C.top_label(*CLASSES).alias("label")).join(held, "id", "left")
    return x.groupBy(F.coalesce("where", F.lit("outside")).alias("place"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(D.with_sql(D.INFRA_SQL, f"lb as (select *, {LABEL} as label from infra)", "ct as (select iso3, label, midpoint, count(*) as n from lb where midpoint is not null group by all)")
    + "select iso3, label, round(median(n), 4) as median_n, max(n) as most, arg_min(n, midpoint) as first_n, arg_max(n, midpoint) as last_n, round(100.0 * (arg_max(n, midpoint) - arg_min(n, midpoint)) / arg_min(n, midpoint), 4) as change from ct group by all")
def d40_counts_by_country(spark: SparkSession, d: str) -> DataFrame:
    """Structures by country and class: monthly median, maximum, first to last change."""
    x = D.infra(spark, d).where("midpoint is not null").groupBy("iso3", C.top_label(*CLASSES).alias("label"), "midpoint").agg(F.count(F.lit(1)).alias("n"))
    first, last = F.min_by("n", "midpoint"), F.max_by("n", "midpoint")
    return x.groupBy("iso3", "label").agg(F.round(F.median("n"), 4).alias("median_n"), F.max("n").alias("most"), first.alias("first_n"), last.alias("last_n"), F.round(100.0 * (last - first) / first, 4).alias("change"))


@query(D.with_sql(D.INFRA_SQL) + "select id, cast(case when extract(day from day) > 15 then date_trunc('month', day) + interval 1 month else date_trunc('month', day) end as date) as month, cast(extract(year from day) as integer) + (extract(doy from day) - 1)::double / extract(doy from make_date(extract(year from day), 12, 31)) as fraction from (select id, midpoint + cast(id % 31 as integer) as day from infra where midpoint is not null)")
def f12_nearest_month(spark: SparkSession, d: str) -> DataFrame:
    """Dates rounded to a month (F12) and as fractional years."""
    x = D.infra(spark, d).where("midpoint is not null").select("id", F.date_add("midpoint", (F.col("id") % 31).cast("int")).alias("day"))
    return x.select("id", bins.nearest_month(F.col("day")).alias("month"), bins.fractional_year(F.col("day")).alias("fraction"))
