"""Queries over the hub table: filters, categories, densities, rasters and country totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import bins, boxes
from tidelane.functions.compat import safe_div
from tidelane.functions.geo import cell_area_km2
from tidelane.operators import hub as H
from tidelane.plans import domain as D
from tidelane.plans.registry import registry

QUERIES, SQL, query = registry()


def ice_sql(a: str = "") -> str:
    """Outside all ice boxes, as SQL text."""
    terms = []
    for w, s, e, n in boxes.ICE_BOXES:
        lon = f"({a}lon > {w} or {a}lon < {e})" if w > e else f"({a}lon > {w} and {a}lon < {e})"
        terms.append(f"({lon} and {a}lat > {s} and {a}lat < {n})")
    return "not (" + " or ".join(terms) + ")"


REPEATS = f"""rep as (
  select d.detect_id, coalesce(repeats_center, 0) as repeats_center, coalesce(repeats_forward, 0) as repeats_forward, coalesce(repeats_back, 0) as repeats_back
  from det d left join (
    select a.detect_id, count(*) filter (abs(g) <= 90 * 86400000000) as repeats_center,
           count(*) filter (g between 0 and 180 * 86400000000) as repeats_forward, count(*) filter (g between -180 * 86400000000 and 0) as repeats_back
    from (select a.detect_id, epoch_us(b.ts) - epoch_us(a.ts) as g
          from (select *, floor(lat * 200) as band from det where ts is not null) a
          join (select *, floor(lat * 200) + o as band from det, (values (-1), (0), (1)) as s(o) where ts is not null) b
            on a.band = b.band and a.detect_id <> b.detect_id and {D.hav_sql('a', 'b')} < 100) a
    group by 1) c on d.detect_id = c.detect_id)"""
QUALITY = "qual as (select scene_id, count(*) as scene_detections, 1 - avg(case when presence < 0.7 or presence is null then 1.0 else 0.0 end) as scene_quality from det group by 1)"
HUB = f"""near_infra as (
  select distinct a.detect_id from (select *, floor(lat * 200) as band from det) a
  join (select *, floor(lat * 200) + o as band from infra, (values (-1), (0), (1)) as s(o)) b on a.band = b.band and {D.hav_sql('a', 'b')} < 200),
hub as (
  select d.*, repeats_center, repeats_forward, repeats_back, scene_detections, scene_quality, overpasses, years_with_overpass, depth_m, shore_km, coalesce(in_road, false) as in_road,
         d.detect_id in (select detect_id from near_infra) as close_to_infra, d.detect_id in (select detect_id from amb where line_dist < 200 and ambiguity_length < source_length) as potential_ambiguity
  from det d join rep using (detect_id) left join qual q on d.scene_id = q.scene_id left join overpass o on d.lat_index = o.lat_index and d.lon_index = o.lon_index)"""
KEPT = f"""kept as (select * from hub where repeats_forward < 3 and repeats_back < 3 and repeats_center < 3 and (scene_detections <= 5 or scene_quality > 0.5)
  and day between date '2017-01-01' and date '2021-12-31' and overpasses > 30 and presence > 0.7 and not in_road and not close_to_infra and not potential_ambiguity and {ice_sql()})"""
CLASSES = """cls as (
  select k.*, on_fishing_list, fishing, fishing_low, fishing_high,
         case when score > 7.4e-6::double and on_fishing_list then 'matched_fishing' when score > 7.4e-6::double and not on_fishing_list then 'matched_nonfishing'
              when score > 7.4e-6::double and on_fishing_list is null then 'matched_unknown' when score < 7.4e-6::double then 'unmatched' end as matched_category
  from kept k left join vessel v on k.ssvid = v.ssvid
  left join (select detect_id, avg(fishing_33) as fishing_low, avg(fishing_50) as fishing, avg(fishing_66) as fishing_high from pred group by 1) p on k.detect_id = p.detect_id)"""
ALL = D.with_sql(D.DET, D.VESSEL, D.PRED, D.OVERPASS, D.INFRA_SQL, D.AMBIGUITY, REPEATS, QUALITY, HUB, KEPT, CLASSES)


def _fields_sql() -> str:
    w = "1.0::double / nullif(overpasses, 0)"
    out = [f"sum(case when matched_category = '{c}' then {w} else 0 end) as {c}" for c in H.CATEGORIES]
    for end in ("", "_low", "_high"):
        out += [
            f"sum(case when matched_category = 'matched_unknown' then fishing{end} * ({w}) else 0 end) as matched_unknown_likelyfish{end}",
            f"sum(case when matched_category = 'matched_unknown' then (1 - fishing{end}) * ({w}) else 0 end) as matched_unknown_likelynonfish{end}",
            f"sum(case when matched_category = 'unmatched' then fishing{end} * ({w}) else 0 end) as unmatched_fishing{end}",
            f"sum(case when matched_category = 'unmatched' then (1 - fishing{end}) * ({w}) else 0 end) as unmatched_nonfishing{end}",
        ]
    return ", ".join([*out, f"sum({w}) as detections"])


FIELD_NAMES = [*H.CATEGORIES, *[f"{a}{e}" for e in ("", "_low", "_high") for a in ("matched_unknown_likelyfish", "matched_unknown_likelynonfish", "unmatched_fishing", "unmatched_nonfishing")], "detections"]


def _hub(spark: SparkSession, d: str) -> DataFrame:
    return H.hub_table(D.det(spark, d), D.overpass(spark, d), D.infra(spark, d), D.ambiguity(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return H.classify(_hub(spark, d), D.vessel(spark, d), D.pred(spark, d))


def _rounded(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _density(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(*H.density_fields())


@query(ALL + f"select iso3, {', '.join(f'round({n}, 6) as {n}' for n in FIELD_NAMES)} from (select iso3, {_fields_sql()} from cls group by 1)")
def a3_density_by_country(spark: SparkSession, d: str) -> DataFrame:
    """Share of activity by country; the flagship of the hub."""
    return _rounded(_density(classified(spark, d), "iso3"), FIELD_NAMES)


@query(D.with_sql(D.DET, QUALITY) + "select scene_id, scene_detections, round(scene_quality, 6) as scene_quality from qual")
def a12_scene_quality(spark: SparkSession, d: str) -> DataFrame:
    return H.scene_quality(D.det(spark, d)).withColumn("scene_quality", F.round("scene_quality", 6))


@query(D.with_sql(D.DET, REPEATS) + "select * from rep")
def j6_repeated_objects(spark: SparkSession, d: str) -> DataFrame:
    return H.repeats(D.det(spark, d))


@query(D.with_sql(D.DET, D.OVERPASS, D.INFRA_SQL, D.AMBIGUITY, REPEATS, QUALITY, HUB) + """select detect_id, scene_id, iso3, repeats_center, repeats_forward, repeats_back, scene_detections, round(scene_quality, 6) as scene_quality, overpasses, years_with_overpass, depth_m, shore_km, in_road, close_to_infra, potential_ambiguity,
  cast(date '2017-01-01' + cast(floor((day - date '2017-01-01') / 24.0) * 24 as integer) as date) as date_24,
  cast(extract(year from ts) * 10 + floor(extract(doy from ts) / 366.5 * 4) as bigint) as pseudo_quarter from hub""")
def d17_hub_table(spark: SparkSession, d: str) -> DataFrame:
    return _hub(spark, d).select(
        "detect_id", "scene_id", "iso3", "repeats_center", "repeats_forward", "repeats_back", "scene_detections", F.round("scene_quality", 6).alias("scene_quality"), "overpasses",
        "years_with_overpass", "depth_m", "shore_km", "in_road", "close_to_infra", "potential_ambiguity",
        bins.period24(F.col("ts")).alias("date_24"), bins.pseudo_quarter(F.col("ts")).alias("pseudo_quarter"),
    )


@query(D.with_sql(D.DET, D.OVERPASS, D.INFRA_SQL, D.AMBIGUITY, REPEATS, QUALITY, HUB, KEPT) + "select detect_id from kept")
def sel_p3_hub_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return H.quality_filter(_hub(spark, d)).select("detect_id")


@query(D.with_sql(D.DET) + f"select detect_id from det where {ice_sql()}")
def sel_p4_free_of_ice(spark: SparkSession, d: str) -> DataFrame:
    return D.det(spark, d).where(boxes.free_of_ice(F.col("lon"), F.col("lat"))).select("detect_id")


@query(D.with_sql(D.INFRA_SQL) + "select id from infra where " + " and ".join(f"not (lat between {s} and {n} and lon between {w} and {e})" for w, s, e, n in boxes.MESSY_BOXES))
def sel_p5_free_of_mess(spark: SparkSession, d: str) -> DataFrame:
    return D.infra(spark, d).where(boxes.free_of_mess(F.col("lon"), F.col("lat"))).select("id")


@query(ALL + "select detect_id, matched_category, round(fishing, 6) as fishing, round(fishing_low, 6) as fishing_low, round(fishing_high, 6) as fishing_high from cls")
def d18_classified_detections(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(classified(spark, d), ["fishing", "fishing_low", "fishing_high"]).select("detect_id", "matched_category", "fishing", "fishing_low", "fishing_high")


@query(ALL + "select detect_id, lat, lon, ssvid, cast(extract(year from ts) as integer) as year, matched_category, round(fishing, 6) as fishing, length_m, overpasses, round(score, 12) as score, iso3 from cls")
def d61_classified_export(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("detect_id", "lat", "lon", "ssvid", F.year("ts").alias("year"), "matched_category", F.round("fishing", 6).alias("fishing"), "length_m", "overpasses", F.round("score", 12).alias("score"), "iso3")


@query(D.with_sql(D.DET, D.PRED) + "select detect_id, round(avg(fishing_33), 6) as fishing_low, round(avg(fishing_50), 6) as fishing, round(avg(fishing_66), 6) as fishing_high from pred group by 1")
def a13_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(H.ensemble(D.pred(spark, d)), ["fishing", "fishing_low", "fishing_high"])


@query(D.with_sql(D.DET, D.VESSEL) + """select detect_id, case when score > 7.4e-6::double and on_fishing_list then 'matched_fishing' when score > 7.4e-6::double and not on_fishing_list then 'matched_nonfishing'
  when score > 7.4e-6::double then 'matched_unknown' when score < 7.4e-6::double then 'unmatched' end as matched_category from det left join vessel using (ssvid)""")
def f27_matched_category(spark: SparkSession, d: str) -> DataFrame:
    x = D.det(spark, d).join(D.vessel(spark, d), "ssvid", "left")
    return x.select("detect_id", bins.matched_category(F.col("score"), F.col("on_fishing_list")).alias("matched_category"))


_TOTALS = "matched_fishing + matched_unknown_likelyfish as ais_fishing, matched_nonfishing + matched_unknown_likelynonfish as ais_nonfishing, unmatched_fishing as dark_fishing, unmatched_nonfishing as dark_nonfishing"


def _totals(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, (F.col("matched_fishing") + F.col("matched_unknown_likelyfish")).alias("ais_fishing"), (F.col("matched_nonfishing") + F.col("matched_unknown_likelynonfish")).alias("ais_nonfishing"),
        F.col("unmatched_fishing").alias("dark_fishing"), F.col("unmatched_nonfishing").alias("dark_nonfishing"),
    )


FOUR = ["ais_fishing", "ais_nonfishing", "dark_fishing", "dark_nonfishing"]


@query(ALL + f"""select lat_bin, lon_bin, {', '.join(f'round({n}, 6) as {n}' for n in FOUR)} from (select lat_bin, lon_bin, {_TOTALS} from (
  select cast(floor(lat * 5) as bigint) as lat_bin, cast(floor(lon * 5) as bigint) as lon_bin, {_fields_sql()} from cls group by 1, 2))""")
def d19_activity_raster(spark: SparkSession, d: str) -> DataFrame:
    x = classified(spark, d).withColumns({"lat_bin": F.floor(F.col("lat") * 5).cast("bigint"), "lon_bin": F.floor(F.col("lon") * 5).cast("bigint")})
    return _rounded(_totals(_density(x, "lat_bin", "lon_bin"), "lat_bin", "lon_bin"), FOUR)


@query(ALL + f"""select iso3, round(dark, 6) as dark, round(dark_low, 6) as dark_low, round(dark_high, 6) as dark_high, round(total, 6) as total, round(dark * 100 / nullif(total, 0), 4) as percent_dark from (
  select iso3, unmatched_fishing + unmatched_nonfishing as dark, unmatched_fishing_low as dark_low, unmatched_fishing_high as dark_high,
         unmatched_fishing + unmatched_nonfishing + matched_fishing + matched_nonfishing + matched_unknown as total from (select iso3, {_fields_sql()} from cls group by 1))""")
def d20_activity_by_country(spark: SparkSession, d: str) -> DataFrame:
    x = _density(classified(spark, d), "iso3")
    dark = F.col("unmatched_fishing") + F.col("unmatched_nonfishing")
    x = x.select("iso3", dark.alias("dark"), F.col("unmatched_fishing_low").alias("dark_low"), F.col("unmatched_fishing_high").alias("dark_high"), (dark + F.col("matched_fishing") + F.col("matched_nonfishing") + F.col("matched_unknown")).alias("total"))
    return _rounded(x.withColumn("percent_dark", safe_div(F.col("dark") * 100, F.col("total"))), ["dark", "dark_low", "dark_high", "total"]).withColumn("percent_dark", F.round("percent_dark", 4))


@query(ALL + f"""select lat_bin, lon_bin, round(v, 6) as v, round(area, 4) as area, round(cum, 6) as cum, round(cum_area, 4) as cum_area,
  case when cum - v < 0.25 * total then 25 when cum - v < 0.5 * total then 50 else 100 end as band from (
  select *, sum(v) over (order by v desc, lat_bin, lon_bin rows unbounded preceding) as cum, sum(area) over (order by v desc, lat_bin, lon_bin rows unbounded preceding) as cum_area, sum(v) over () as total from (
    select lat_bin, lon_bin, round(detections, 9) as v, 111.0::double * 111.0::double / 4 * cos(radians(lat_bin / 2.0::double)) as area from (
      select cast(floor(lat * 2) as bigint) as lat_bin, cast(floor(lon * 2) as bigint) as lon_bin, {_fields_sql()} from cls group by 1, 2) where detections is not null))""")
def d21_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Cells by falling density with running totals: the area that holds a quarter, half and all of the activity. Cells are few (a grid), so one ordered window is bounded."""
    x = classified(spark, d).withColumns({"lat_bin": F.floor(F.col("lat") * 2).cast("bigint"), "lon_bin": F.floor(F.col("lon") * 2).cast("bigint")})
    g = _density(x, "lat_bin", "lon_bin").where("detections is not null").select("lat_bin", "lon_bin", F.round("detections", 9).alias("v"), cell_area_km2(F.col("lat_bin") / 2.0, 2).alias("area"))
    w = Window.orderBy(F.desc("v"), "lat_bin", "lon_bin").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"cum": F.sum("v").over(w), "cum_area": F.sum("area").over(w), "total": F.sum("v").over(Window.partitionBy())})
    band = F.when(F.col("cum") - F.col("v") < 0.25 * F.col("total"), 25).when(F.col("cum") - F.col("v") < 0.5 * F.col("total"), 50).otherwise(100)
    return g.select("lat_bin", "lon_bin", F.round("v", 6).alias("v"), F.round("area", 4).alias("area"), F.round("cum", 6).alias("cum"), F.round("cum_area", 4).alias("cum_area"), band.alias("band"))


@query(ALL + "select inside, count(*) as detections, count(*) filter (matched_category = 'unmatched') as dark, round(100.0 * count(*) filter (matched_category = 'unmatched') / count(*), 4) as percent_dark from (select *, (lat between -11 and 31 and lon between -101 and -19) as inside from cls where matched_category is not null) group by 1")
def d60_extent_share(spark: SparkSession, d: str) -> DataFrame:
    x = classified(spark, d).where("matched_category is not null").withColumn("inside", boxes.within_extent(F.col("lon"), F.col("lat"), (-100.0, -10.0, -20.0, 30.0), 1.0))
    dark = F.count_if(F.col("matched_category") == "unmatched")
    return x.groupBy("inside").agg(F.count(F.lit(1)).alias("detections"), dark.alias("dark"), F.round(dark * 100.0 / F.count(F.lit(1)), 4).alias("percent_dark"))


@query(ALL + """select detect_id, case when matched_category in ('matched_fishing', 'matched_nonfishing') then matched_category
  when matched_category = 'matched_unknown' and fishing > 0.5 then 'matched_fishing' when matched_category = 'matched_unknown' and fishing < u then 'matched_nonfishing'
  when matched_category = 'unmatched' and fishing > u then 'unmatched_fishing' when matched_category = 'unmatched' then 'unmatched_nonfishing' end as dithered
  from (select *, (cast(floor(length_m * 10) as bigint) * 7919 % 1000) / 1000.0::double as u from cls)""")
def f28_dithered_category(spark: SparkSession, d: str) -> DataFrame:
    u = (F.floor(F.col("length_m") * 10).cast("bigint") * 7919 % 1000) / 1000.0
    return classified(spark, d).select("detect_id", bins.dithered_category(F.col("matched_category"), F.col("fishing"), u).alias("dithered"))


@query(ALL + """select dist_bin, label, n, round(share, 6) as share from (
  select dist_bin, label, n, avg(n) over (partition by label order by dist_bin rows between 1 preceding and 1 following) / sum(n) over (partition by label) as share, count(*) over (partition by label order by dist_bin rows between 1 preceding and 1 following) as k
  from (select cast(floor(abs(lat) / 5) as bigint) as dist_bin, matched_category as label, count(*) as n from cls where matched_category is not null group by 1, 2)) where k = 3""")
def d59_binned_share(spark: SparkSession, d: str) -> DataFrame:
    x = classified(spark, d).where("matched_category is not null").groupBy(F.floor(F.abs("lat") / 5).cast("bigint").alias("dist_bin"), F.col("matched_category").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy("dist_bin").rowsBetween(-1, 1)
    x = x.withColumns({"share": F.avg("n").over(w) / F.sum("n").over(Window.partitionBy("label")), "k": F.count("n").over(w)})
    return x.where("k = 3").select("dist_bin", "label", "n", F.round("share", 6).alias("share"))


@query(D.with_sql(D.DET, D.OVERPASS) + """select zone, count(*) as cells, round(sum(area), 4) as area, round(sum(case when overpasses >= 30 then area else 0 end), 4) as imaged from (
  select *, coalesce(iso3, 'highseas') as zone, 111.0::double * 111.0::double / 400 * cos(radians((lat_index + 0.5::double) / 20)) as area from (
    select lat_index, lon_index, max(overpasses) as overpasses, case when max(overpasses) % 7 <> 0 then 'E' || cast(cast(floor(lon_index / 1200.0::double) as bigint) as varchar) end as iso3 from overpass group by 1, 2)) group by 1""")
def a19_zone_area(spark: SparkSession, d: str) -> DataFrame:
    o = D.overpass(spark, d).withColumn("iso3", F.when(F.col("overpasses") % 7 != 0, F.concat(F.lit("E"), F.floor(F.col("lon_index") / 1200.0).cast("bigint").cast("string"))))
    o = o.withColumns({"zone": F.coalesce("iso3", F.lit("highseas")), "area": cell_area_km2((F.col("lat_index") + 0.5) / 20, 20)})
    return o.groupBy("zone").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("area"), 4).alias("area"), F.round(F.sum(F.when(F.col("overpasses") >= 30, F.col("area")).otherwise(0.0)), 4).alias("imaged"))


#: Depths and distances to shore that split a zone's area and activity.
DEPTHS, SHORES = (200, 1000), (22, 370)
_PARTS = {**{f"shallower_{m}": ("depth_m", m) for m in DEPTHS}, **{f"nearer_{k}": ("shore_km", k) for k in SHORES}}


@query(ALL + f"""select iso3, round(area, 4) as area, {', '.join(f'round(area_{n}, 6) as area_{n}' for n in _PARTS)},
    round(coalesce(detections, 0), 6) as detections, round(coalesce(west, 0), 6) as west, round(coalesce(east, 0), 6) as east, {', '.join(f'round(coalesce({n}, 0), 6) as {n}' for n in _PARTS)} from (
    select iso3, sum(km2) as area, {', '.join(f'sum(case when {c} < {v} then km2 else 0 end) / sum(km2) as area_{n}' for n, (c, v) in _PARTS.items())} from (
      select *, 'E' || cast(cast(floor((lon_index / 20.0::double + 180) / 60) as bigint) as varchar) || cast(cast(floor((lat_index / 20.0::double + 90) / 60) as bigint) as varchar) as iso3,
             111.0::double * 111.0::double / 400 * cos(radians((lat_index + 0.5::double) / 20)) as km2 from overpass) group by 1)
  full join (select iso3, sum(w) as detections, sum(case when lon < 127 then w end) as west, sum(case when lon >= 127 then w end) as east, {', '.join(f'sum(case when {c} < {v} then w end) as {n}' for n, (c, v) in _PARTS.items())}
    from (select *, 1.0::double / nullif(overpasses, 0) as w from cls) group by 1) using (iso3)""")
def d23_zone_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Area and activity by zone, with the shares of the area, and the activity, in shallow waters and near the shore; the activity also split at a meridian."""
    zone = F.concat(F.lit("E"), F.floor((F.col("lon_index") / 20.0 + 180) / 60).cast("bigint").cast("string"), F.floor((F.col("lat_index") / 20.0 + 90) / 60).cast("bigint").cast("string"))
    o = D.overpass(spark, d).withColumns({"iso3": zone, "km2": cell_area_km2((F.col("lat_index") + 0.5) / 20, 20)})
    area = o.groupBy("iso3").agg(F.sum("km2").alias("area"), *[(F.sum(F.when(F.col(c) < v, F.col("km2")).otherwise(0.0)) / F.sum("km2")).alias(f"area_{n}") for n, (c, v) in _PARTS.items()])
    w = safe_div(F.lit(1), F.col("overpasses"))
    split = {"west": F.col("lon") < 127, "east": F.col("lon") >= 127, **{n: F.col(c) < v for n, (c, v) in _PARTS.items()}}
    act = classified(spark, d).groupBy("iso3").agg(F.sum(w).alias("detections"), *[F.sum(F.when(c, w)).alias(n) for n, c in split.items()])
    rounded = [F.round(f"area_{n}", 6).alias(f"area_{n}") for n in _PARTS] + [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("detections", *split)]
    return area.join(act, "iso3", "full").select("iso3", F.round("area", 4).alias("area"), *rounded)


@query(D.with_sql(D.DET, D.OVERPASS) + "select distinct cast(floor(lat_index / 4.0::double) as bigint) as lat_bin, cast(floor(lon_index / 4.0::double) as bigint) as lon_bin from overpass where overpasses >= 30")
def d22_study_area(spark: SparkSession, d: str) -> DataFrame:
    """Coarse cells with a well-imaged fine cell."""
    o = D.overpass(spark, d).groupBy("lat_index", "lon_index").agg(F.max("overpasses").alias("n")).where("n >= 30")
    return o.select(F.floor(F.col("lat_index") / 4.0).cast("bigint").alias("lat_bin"), F.floor(F.col("lon_index") / 4.0).cast("bigint").alias("lon_bin")).distinct()
