"""Queries over rasters in time and time series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import bins
from tidelane.operators import series as S
from tidelane.operators.hub import CATEGORIES
from tidelane.plans import domain as D
from tidelane.plans.hub import ALL, classified
from tidelane.plans.registry import registry
from tidelane.runtime import read_table

QUERIES, SQL, query = registry()

#: One row for each scene and coarse cell (1 degree) seen by its detections.
SEEN = "seen as (select distinct scene_id, day, cast(floor(lat) as bigint) as lat_bin, cast(floor(lon) as bigint) as lon_bin from det where scene_id is not null and day is not null)"


def seen(spark: SparkSession, d: str) -> DataFrame:
    x = D.det(spark, d).where("scene_id is not null and day is not null")
    return x.select("scene_id", "day", F.floor("lat").cast("bigint").alias("lat_bin"), F.floor("lon").cast("bigint").alias("lon_bin")).distinct()


def p24(c: str) -> str:
    return f"cast(date '2017-01-01' + cast(floor(({c} - date '2017-01-01') / 24.0) * 24 as integer) as date)"


@query(D.with_sql(D.DET, SEEN) + "select cast(extract(year from day) as integer) as year, lat_bin, lon_bin, count(*) as overpasses from seen group by all")
def d16_overpasses_by_year(spark: SparkSession, d: str) -> DataFrame:
    return seen(spark, d).groupBy(F.year("day").alias("year"), "lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("overpasses"))


@query(D.with_sql(D.DET, SEEN, "bad as (select scene_id from det group by 1 having 1 - avg(case when presence < 0.7 or presence is null then 1.0 else 0 end) < 0.5)")
    + "select cast(extract(year from day) as integer) as year, lat_bin, lon_bin, count(*) as overpasses from seen where scene_id not in (select scene_id from bad where scene_id is not null) group by all")
def j23_overpasses_without_bad_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of low quality left out by an anti join."""
    from tidelane.operators.hub import scene_quality

    bad = scene_quality(D.det(spark, d).where("scene_id is not null")).where("scene_quality < 0.5").select("scene_id")
    return seen(spark, d).join(bad, "scene_id", "left_anti").groupBy(F.year("day").alias("year"), "lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("overpasses"))


@query(D.with_sql(D.DET, SEEN) + "select cast(extract(year from day) * 10 + floor(extract(doy from day) / 366.5 * 4) as bigint) as quarter, lat_bin, lon_bin, count(*) as overpasses from seen group by all")
def d16_overpasses_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return seen(spark, d).groupBy(bins.pseudo_quarter(F.col("day")).alias("quarter"), "lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("overpasses"))


@query(D.with_sql(D.DET, SEEN) + f"select {p24('day')} as period, lat_bin, lon_bin, count(*) as overpasses from seen group by all")
def j18_tumbling_periods(spark: SparkSession, d: str) -> DataFrame:
    """24-day periods by arithmetic, no join."""
    return seen(spark, d).groupBy(bins.period24(F.col("day")).alias("period"), "lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("overpasses"))


@query(D.with_sql(D.DET, SEEN) + "select rolling_date, lat_bin, lon_bin, count(*) as overpasses from (select *, cast(unnest(generate_series(day - 11, day + 12, interval 1 day)) as date) as rolling_date from seen) group by all")
def j16_rolling_24_days(spark: SparkSession, d: str) -> DataFrame:
    """Facts between 12 days before and 11 after each day."""
    return S.rolling_expand(seen(spark, d), "day", 11, 12).groupBy("rolling_date", "lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("overpasses"))


@query(D.with_sql(D.DET, SEEN, "per as (select cast(unnest(generate_series(date '2016-06-11', date '2022-06-30', interval 24 day)) as date) as period)")
    + "select period, lat_bin, lon_bin, round(count(*) / 4.0::double, 6) as overpasses from seen join per on day between period - 48 and period + 48 group by all")
def j17_smoothed_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every 24 days, facts up to 48 days on either side."""
    x = S.smoothed_periods(seen(spark, d), "day", dt.date(2016, 6, 11))
    return x.groupBy("period", "lat_bin", "lon_bin").agg(F.round(F.count(F.lit(1)) / 4.0, 6).alias("overpasses"))


FACTS = f"fct as (select {p24('day')} as period, lat_bin, lon_bin, count(*) as n from seen group by all)"
GRID = "grd as (select c.*, p.period, coalesce(n, 0) as n, n is null as is_missing from (select distinct lat_bin, lon_bin from fct) c cross join (select distinct period from fct) p left join fct using (lat_bin, lon_bin, period))"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    f = seen(spark, d).groupBy(bins.period24(F.col("day")).alias("period"), "lat_bin", "lon_bin").agg(F.count(F.lit(1)).alias("n"))
    return S.densify(f, f, f, ["lat_bin", "lon_bin"], "period", ["n"])


@query(D.with_sql(D.DET, SEEN, FACTS, GRID) + "select * from grd")
def j20_densify(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("lat_bin", "lon_bin", "period", "n", "is_missing")


ZERO = "zer as (select lat_bin, lon_bin, period, n, is_missing, round(n * (1 + abs(lat_bin) % 3) / 4.0::double, 6) as density from grd)"


@query(D.with_sql(D.DET, SEEN, FACTS, GRID, ZERO) + "select * from zer")
def d24_zero_filled_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("lat_bin", "lon_bin", "period", "n", "is_missing", F.round(F.col("n") * (1 + F.abs("lat_bin") % 3) / 4.0, 6).alias("density"))


@query(D.with_sql(D.DET, SEEN, FACTS, GRID, ZERO, """itp as (select *, last_value(case when not is_missing then {'x': period, 'y': density} end ignore nulls) over (partition by lat_bin, lon_bin order by period rows between unbounded preceding and current row) as p,
  first_value(case when not is_missing then {'x': period, 'y': density} end ignore nulls) over (partition by lat_bin, lon_bin order by period rows between current row and unbounded following) as q,
  max(case when not is_missing then density end) over (partition by lat_bin, lon_bin) as m from zer)""")
    + """select lat_bin, lon_bin, period, round(case when not is_missing then density when m > 0 then coalesce(p.y + (q.y - p.y) * (period - p.x) / nullif(q.x - p.x, 0), p.y, q.y) end, 6) as density_i from itp""")
def d25_gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    x = d24_zero_filled_grid(spark, d)
    x = S.interpolate_gaps(x, ["lat_bin", "lon_bin"], "period", "density", ~F.col("is_missing"))
    return x.select("lat_bin", "lon_bin", "period", F.round("density_i", 6).alias("density_i"))


def _rolling_sql(back: int, ahead: int, where: str) -> str:
    """Rows of cls as one for each day of their window, as SQL text."""
    return f"(select *, cast(unnest(generate_series(day - {back}, day + {ahead}, interval 1 day)) as date) as rolling_date from cls where day is not null and {where})"


PARTS = (*CATEGORIES, "unmatched")


@query(ALL + f"""select rolling_date, coalesce(a.iso3, '') as iso3, {', '.join(f'round(coalesce({c}, 0) / 24.0::double, 6) as {c}' for c in PARTS)}, round(coalesce(dark_fishing, 0) / 24.0::double, 6) as dark_fishing, round(coalesce(m, 0.0) / 24.0::double, 6) as long_per_day,
  (make_date(cast(extract(year from rolling_date) as bigint), 1, 13) - rolling_date) % 24 = 0 as window_start
  from (select rolling_date, iso3, {', '.join(f"count(*) filter (matched_category = '{c}') as {c}" for c in PARTS)}, sum(fishing) filter (matched_category = 'unmatched') as dark_fishing from {_rolling_sql(11, 12, 'true')} group by all) a
  full join (select rolling_date, iso3, count(*) as m from {_rolling_sql(11, 12, 'length_m > 100')} group by all) b using (rolling_date, iso3)""")
def d26_rolling_series(spark: SparkSession, d: str) -> DataFrame:
    """24-day rolling means by country and category, of the dark fishing share and of long detections, joined fully (J25), with the starts of windows that don't overlap."""
    x = classified(spark, d).where("day is not null")
    count = [F.count_if(F.col("matched_category") == c).alias(c) for c in PARTS]
    a = S.rolling_expand(x.select("iso3", "day", "matched_category", "fishing"), "day", 11, 12).groupBy("rolling_date", "iso3").agg(*count, F.sum(F.when(F.col("matched_category") == "unmatched", F.col("fishing"))).alias("dark_fishing"))
    b = S.rolling_expand(x.where("length_m > 100").select("iso3", "day"), "day", 11, 12).groupBy("rolling_date", "iso3").agg(F.count(F.lit(1)).alias("m"))
    each = lambda c, name: F.round(F.coalesce(c, F.lit(0)) / 24.0, 6).alias(name)
    return a.join(b, ["rolling_date", "iso3"], "full").select("rolling_date", "iso3", *[each(F.col(c), c) for c in (*PARTS, "dark_fishing")], each(F.col("m"), "long_per_day"), bins.reset_window(F.col("rolling_date")).alias("window_start"))


@query(ALL + f"""select rolling_date, {', '.join(f"count(*) filter (matched_category = '{c}') as {c}" for c in PARTS)}, round(coalesce(sum(fishing) filter (matched_category = 'unmatched'), 0), 6) as dark_fishing
  from {_rolling_sql(12, 11, "iso3 = 'E22' and lon < 127 and years_with_overpass >= 2")} group by 1""")
def d64_western_series(spark: SparkSession, d: str) -> DataFrame:
    """The rolling series of one zone west of a meridian by category, in cells imaged in two years or more, event side."""
    x = classified(spark, d).where("iso3 = 'E22' and lon < 127 and years_with_overpass >= 2 and day is not null").select("day", "matched_category", "fishing")
    count = [F.count_if(F.col("matched_category") == c).alias(c) for c in PARTS]
    dark = F.sum(F.when(F.col("matched_category") == "unmatched", F.col("fishing")))
    return S.rolling_expand(x, "day", 12, 11).groupBy("rolling_date").agg(*count, F.round(F.coalesce(dark, F.lit(0.0)), 6).alias("dark_fishing"))


DAILY = "dly as (select cast(l_shipdate as date) as day, l_returnflag as flag, count(*) as n, sum(l_quantity) as q from lineitem group by all)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query(D.with_sql(DAILY) + """select day, flag, case when count(*) over w = 3 then round(median(q) over w, 6) end as med3, case when count(*) over v = 3 then round(avg(q) over v, 6) end as mean3, case when count(*) over y = 12 then round(avg(q) over y, 6) end as mean12
  from dly window w as (partition by flag order by day rows between 1 preceding and 1 following), v as (partition by flag order by day rows between 2 preceding and current row), y as (partition by flag order by day rows between 11 preceding and current row)""")
def w13_rolling_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d)
    stat = lambda back, ahead, s: F.round(S.rolling_stat(["flag"], "day", back, ahead, s), 6)
    return x.select("day", "flag", stat(1, 1, S.median_of_three("q")).alias("med3"), stat(2, 0, F.avg("q").over).alias("mean3"), stat(11, 0, F.avg("q").over).alias("mean12"))


@query(D.with_sql(DAILY, "med as (select flag, cast(extract(year from day) as integer) as year, median(q) as m, stddev_samp(q) as sd, count(*) as k from dly group by all)")
    + """select flag, round(avg(m) filter (year < 1998), 6) as before, round(avg(m) filter (year >= 1998), 6) as after, round(100 * (avg(m) filter (year >= 1998) / avg(m) filter (year < 1998) - 1), 4) as change,
  round(sqrt(sum((k - 1) * sd * sd) / sum(k - 1)), 6) as pooled_sd, round(regr_slope(m, year), 6) as per_year from med group by 1""")
def d30_yearly_medians(spark: SparkSession, d: str) -> DataFrame:
    m = daily(spark, d).groupBy("flag", F.year("day").alias("year")).agg(F.median("q").alias("m"), F.stddev_samp("q").alias("sd"), F.count(F.lit(1)).alias("k"))
    before, after = F.avg(F.when(F.col("year") < 1998, F.col("m"))), F.avg(F.when(F.col("year") >= 1998, F.col("m")))
    return m.groupBy("flag").agg(
        F.round(before, 6).alias("before"), F.round(after, 6).alias("after"), F.round(100 * (after / before - 1), 4).alias("change"),
        F.round(F.sqrt(F.sum((F.col("k") - 1) * F.pow("sd", 2)) / F.sum(F.col("k") - 1)), 6).alias("pooled_sd"), F.round(F.regr_slope("m", "year"), 6).alias("per_year"),
    )


@query(D.with_sql(DAILY, "mon as (select flag, (extract(year from day) - 1995) * 12 + extract(month from day) as x, sum(q) as y from dly group by all)",
    "s as (select flag, count(*)::double s0, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2 from mon group by 1)",
    "k as (select *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) as dd from s)")
    + """select flag, round((t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / dd, 4) as c0, round((s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / dd, 4) as c1,
  round((s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / dd, 4) as c2 from k""")
def d32_quadratic_trend(spark: SparkSession, d: str) -> DataFrame:
    m = daily(spark, d).groupBy("flag", ((F.year("day") - 1995) * 12 + F.month("day")).cast("double").alias("x")).agg(F.sum("q").alias("y"))
    return S.quadratic_trend(m, ["flag"], "x", "y").select("flag", *[F.round(c, 4).alias(c) for c in ("c0", "c1", "c2")])


@query()
def d28_trend_and_cycle(spark: SparkSession, d: str) -> DataFrame:
    x = S.trend_and_cycle(daily(spark, d), "flag", "day", "q", 1e6)
    return x.select("flag", "day", F.round("trend", 4).alias("trend"), F.round("cycle", 4).alias("cycle"))


@query()
def d29_despike(spark: SparkSession, d: str) -> DataFrame:
    return S.despike(daily(spark, d), "flag", "day", "q").withColumn("clean", F.round("clean", 4))


@query()
def d31_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    x = S.block_bootstrap(daily(spark, d), "flag", "day", "q", dt.date(1998, 1, 1))
    return x.select("flag", *[F.round(c, 4).alias(c) for c in ("change", "low", "high", "block")])


@query(D.with_sql(D.OVERPASS.replace("from det", "from (select cast(floor(lat * 20) as bigint) as lat_index, cast(floor(lon * 20) as bigint) as lon_index from det)"), ).replace("with ", "with " + D.DET + ",\n", 1)
    + "select cast(floor(lat_index / 20.0::double) as bigint) as lat_bin, cast(floor(lon_index / 20.0::double) as bigint) as lon_bin, round(avg(overpasses % 50), 6) as angle, round(sum(1.0::double / 20 / 20), 8) as share from overpass group by all")
def a20_downsample(spark: SparkSession, d: str) -> DataFrame:
    """A fine raster to one 20 times coarser: mean angle and the share of the coarse cell that is covered."""
    o = D.overpass(spark, d)
    return o.groupBy(F.floor(F.col("lat_index") / 20.0).cast("bigint").alias("lat_bin"), F.floor(F.col("lon_index") / 20.0).cast("bigint").alias("lon_bin")).agg(F.round(F.avg(F.col("overpasses") % 50), 6).alias("angle"), F.round(F.sum(F.lit(1.0 / 20 / 20)), 8).alias("share"))


@query(D.with_sql(D.DET, SEEN, FACTS) + """select period, cast(sum(case when lat_bin >= 0 then n else 0 end) as bigint) as north, cast(sum(case when lat_bin < 0 then n else 0 end) as bigint) as south from fct group by 1""")
def j26_stack_unstack(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide with zeros for what is missing."""
    x = j18_tumbling_periods(spark, d).withColumn("half", F.when(F.col("lat_bin") >= 0, "north").otherwise("south"))
    return x.groupBy("period").pivot("half", ["north", "south"]).agg(F.sum("overpasses")).fillna(0)
