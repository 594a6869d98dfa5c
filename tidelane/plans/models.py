"""Queries around models: features, evaluation, calibration, images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.bins import scene_time
from tidelane.functions.geo import cell_area_km2
from tidelane.operators import evaluation as E
from tidelane.operators import features as X
from tidelane.operators import images as I
from tidelane.plans import domain as D
from tidelane.plans.registry import registry
from tidelane.runtime import read_table

QUERIES, SQL, query = registry()

# ---- features ------------------------------------------------------------------------------------------------------

CELLS = "cel as (select lat_bin, lon_bin, lat_bin / 20.0::double as lat, lon_bin / 20.0::double as lon, v from (select cast(floor(lat * 20) as bigint) as lat_bin, cast(floor(lon * 20) as bigint) as lon_bin, count(*)::double as v from ping group by all))"


def cells(spark: SparkSession, d: str) -> DataFrame:
    g = D.ping(spark, d).groupBy(F.floor(F.col("lat") * 20).cast("bigint").alias("lat_bin"), F.floor(F.col("lon") * 20).cast("bigint").alias("lon_bin")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return g.select("lat_bin", "lon_bin", (F.col("lat_bin") / 20.0).alias("lat"), (F.col("lon_bin") / 20.0).alias("lon"), "v")


@query(D.with_sql(D.PING, CELLS) + f"""select a.lat_bin, a.lon_bin, count(*) as cells, round(sum(b.v), 4) as total, round(sum(b.v) / (pi() * 100), 8) as per_km2, round(stddev_samp(b.v), 6) as spread
  from cel a join (select * replace (lat_bin + o as lat_bin), lat_bin as own from cel, (select unnest(range(-3, 4)) as o)) b on a.lat_bin = b.lat_bin and (abs(a.lon_bin - b.lon_bin) < 40 or abs(a.lon_bin - b.lon_bin) > 7160) where {D.hav_sql('a', 'b')} <= 10000 group by all""")
def j8_radius_density(spark: SparkSession, d: str) -> DataFrame:
    """Traffic within 10 km of each cell."""
    r = F.col("r_v")
    x = X.radius_aggregate(cells(spark, d), 10_000.0, [F.count(F.lit(1)).alias("cells"), F.round(F.sum(r), 4).alias("total"), F.round(F.sum(r) / (np.pi * 100), 8).alias("per_km2"), F.round(F.stddev_samp(r), 6).alias("spread")])
    return x


@query(D.with_sql(D.PING, CELLS) + "select lat_bin, lon_bin, v, " + "greatest(" + ", ".join(f"abs(max(v) over {w}{k} - v) / {k}" for w in ("x", "y") for k in (1, 2, 3)) + ") as slope from cel window " + ", ".join(f"{w}{k} as (partition by {p} order by {o} range between {k} following and {k} following)" for w, p, o in (("x", "lat_bin", "lon_bin"), ("y", "lon_bin", "lat_bin")) for k in (1, 2, 3)))
def w2_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Change to neighbours 1 to 3 cells on, along both axes."""
    return X.slopes(cells(spark, d).select("lat_bin", "lon_bin", "v"), "v")


@query(D.with_sql(D.PING, CELLS) + """select seg_id, ts, round(case when count(v) = 4 then sum(v * s) end, 6) as v from (
  select p.seg_id, p.ts, case o.dy when 0 then 1 - fy else fy end * case o.dx when 0 then 1 - fx else fx end as s, c.v
  from (select *, lat * 20 - floor(lat * 20) as fy, lon * 20 - floor(lon * 20) as fx from ping) p, (values (0, 0), (0, 1), (1, 0), (1, 1)) as o(dy, dx)
  left join cel c on c.lat_bin = cast(floor(p.lat * 20) as bigint) + o.dy and c.lon_bin = cast(floor(p.lon * 20) as bigint) + o.dx) group by 1, 2""")
def j15_bilinear_resample(spark: SparkSession, d: str) -> DataFrame:
    """A grid's value at any point from its four corners."""
    p = D.ping(spark, d).select(F.struct("seg_id", "ts").alias("id"), "lat", "lon")
    return X.bilinear_resample(cells(spark, d), p, "v", 20).select("id.seg_id", "id.ts", F.round("v", 6).alias("v"))


@query(D.with_sql(D.DET, D.PING, D.OVERPASS, CELLS) + """select detect_id, round(coalesce(c.v, 0), 4) as traffic, overpasses, round(111.0::double * 111.0::double / 400 * cos(radians(d.lat)), 6) as area from det d left join cel c on c.lat_bin = d.lat_index and c.lon_bin = d.lon_index left join overpass o on o.lat_index = d.lat_index and o.lon_index = d.lon_index""")
def d42_feature_join(spark: SparkSession, d: str) -> DataFrame:
    """Layers of one grid joined wide onto detections by cell."""
    x = D.det(spark, d).join(cells(spark, d).select(F.col("lat_bin").alias("lat_index"), F.col("lon_bin").alias("lon_index"), "v"), ["lat_index", "lon_index"], "left").join(D.overpass(spark, d), ["lat_index", "lon_index"], "left")
    return x.select("detect_id", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("traffic"), "overpasses", F.round(cell_area_km2(F.col("lat"), 20), 6).alias("area"))


# ---- evaluation ----------------------------------------------------------------------------------------------------

TRUTH = "tru as (select doc_id, case when n_chars % 10 >= 4 then 1 else 0 end as y, ((n_chars * 37 + doc_id * 11) % 101) / 100.0::double as s, n_chars::double as v, n_chars * 0.9::double + (doc_id % 50) as vh from documents)"


def truth(spark: SparkSession, d: str) -> DataFrame:
    n, i = F.col("n_chars"), F.col("doc_id")
    return read_table(spark, d, "documents").select("doc_id", F.when(n % 10 >= 4, 1).otherwise(0).alias("y"), (((n * 37 + i * 11) % 101) / 100.0).alias("s"), n.cast("double").alias("v"), (n * 0.9 + i % 50).alias("vh"))


def _said(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).withColumn("yhat", F.when(F.col("s") >= 0.5, 1).otherwise(0))


@query(D.with_sql(TRUTH) + "select y, case when s >= 0.5::double then 1 else 0 end as yhat, count(*) as n from tru group by all")
def d49_confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_said(spark, d), "y", "yhat")


@query(D.with_sql(TRUTH, "k as (select count(*)::double n, count(*) filter (y = 1 and s >= 0.5::double) tp, count(*) filter (y = 0 and s >= 0.5::double) fp, count(*) filter (y = 1 and s < 0.5::double) fn, count(*) filter (y = 0 and s < 0.5::double) tn from tru)")
    + "select n, round((tp + tn) / n, 8) as accuracy, round(tp / (tp + fp)::double, 8) as precision, round(tp / (tp + fn)::double, 8) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 8) as f1, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 8) as kappa from k")
def d49_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.metrics(_said(spark, d), "y", "yhat", 1).select("n", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1", "kappa")])


@query(D.with_sql(TRUTH) + "select round(sum(case when a.s > b.s then a.n * b.n when a.s = b.s then a.n * b.n / 2.0 else 0 end) / sum(a.n * b.n), 8) as auc from (select s, count(*)::double as n from tru where y = 1 group by 1) a, (select s, count(*)::double as n from tru where y = 0 group by 1) b")
def d49_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_auc(truth(spark, d), "y", "s").select(F.round("auc", 8).alias("auc"))


@query(D.with_sql(TRUTH) + "select round(1 - sum(pow(v - vh, 2)) / (var_pop(v) * count(*)), 8) as r2, round(sqrt(avg(pow(v - vh, 2))), 6) as rmse, round(sqrt(sum(s * pow(v - vh, 2)) / sum(s)), 6) as weighted_rmse from tru")
def d49_regression(spark: SparkSession, d: str) -> DataFrame:
    r = E.regression(truth(spark, d), "v", "vh", F.col("s"))
    return r.select(F.round("r2", 8).alias("r2"), F.round("rmse", 6).alias("rmse"), F.round("weighted_rmse", 6).alias("weighted_rmse"))


@query(D.with_sql(TRUTH) + "select doc_id from tru, (select avg(v - vh) as m, stddev_samp(v - vh) as sd from tru) where abs(v - vh - m) > 2 * sd")
def d49_residual_outliers(spark: SparkSession, d: str) -> DataFrame:
    return E.residual_outliers(truth(spark, d), "v", "vh", 2.0).select("doc_id")


CURVE = "crv as (select cast(least(floor(s * 10), 9) as bigint) as bin, avg(s) as mean_score, avg(y::double) as observed, count(*) as n from tru group by 1)"


@query(D.with_sql(TRUTH, CURVE) + "select bin, round(mean_score, 8) as mean_score, round(observed, 8) as observed, n from crv")
def d50_reliability(spark: SparkSession, d: str) -> DataFrame:
    c = E.reliability(truth(spark, d), "y", "s")
    return c.select("bin", F.round("mean_score", 8).alias("mean_score"), F.round("observed", 8).alias("observed"), "n")


@query(D.with_sql(TRUTH, CURVE, "seg as (select mean_score as x0, observed as y0, lead(mean_score) over w as x1, lead(observed) over w as y1 from crv window w as (order by mean_score))",
    "tab as (select h as hundredth, coalesce(case when h / 100.0::double < (select min(mean_score) from crv) then (select arg_min(observed, mean_score) from crv) when h / 100.0::double >= (select max(mean_score) from crv) then (select arg_max(observed, mean_score) from crv) end, y0 + (y1 - y0) * (h / 100.0::double - x0) / (x1 - x0)) as calibrated from range(0, 101) r(h) left join seg on h / 100.0::double >= x0 and h / 100.0::double < x1)")
    + "select doc_id, round(calibrated, 6) as calibrated from tru left join tab on hundredth = cast(round(s * 100) as bigint)")
def d50_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Scores through the lookup of the reliability curve."""
    t = truth(spark, d)
    return E.calibrate(t, "s", E.calibration_table(E.reliability(t, "y", "s"))).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query(D.with_sql(D.DET) + "select fold, count(distinct day) as days, count(*) as n from (select *, cast(('0x' || substr(md5('0:' || strftime(day, '%Y-%m-%d')), 1, 8))::ubigint % 5 as integer) as fold from det where day is not null) group by 1")
def d51_group_split(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of whole days."""
    x = D.det(spark, d).where("day is not null")
    return x.withColumn("fold", E.fold(F.col("day").cast("string"), 5)).groupBy("fold").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("n"))


@query(D.with_sql(TRUTH) + "select doc_id, y, case when s >= 0.5::double then 1 else 0 end as yhat, round(1 - s, 6) as uncertainty from tru where y <> case when s >= 0.5::double then 1 else 0 end and s > 0.2::double")
def d62_misclassified(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, d).where("y <> yhat and s > 0.2").select("doc_id", "y", "yhat", F.round(1 - F.col("s"), 6).alias("uncertainty"))


@query(D.with_sql(TRUTH) + "select round(avg(case when v > 0 then pow(v - vh, 2) else 0 end), 4) as loss from tru")
def d63_masked_error(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).agg(F.round(F.avg(E.masked_squared_error(F.col("v"), F.col("vh"))), 4).alias("loss"))


# ---- images --------------------------------------------------------------------------------------------------------

def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 8 x 8 from the vectors."""
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("tile_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("vals"), "label")


PIX = "pix as (select vec_id, label, i // 8 as y, i % 8 as x, v::double as v from (select vec_id, label, unnest(embedding) as v, unnest(range(64)) as i from embeddings))"


@query()
def d44_bright_regions(spark: SparkSession, d: str) -> DataFrame:
    x = I.detect(tiles(spark, d))
    return x.select("tile_id", F.round("row", 4).alias("row"), F.round("col", 4).alias("col"), "pixels", F.round("peak", 6).alias("peak"))


@query(D.with_sql(PIX) + "select vec_id, y, x, round(pow(10.0::double, v * 10 / 10) * 10000 * sin(radians(30.0 + x)), 4) as power from pix")
def d45_backscatter(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d)
    return p.select("vec_id", "y", "x", F.round(I.to_backscatter(F.col("v") * 10, 30.0 + F.col("x")), 4).alias("power"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "f"))
    return p.select("vec_id", "label", F.floor(F.col("i") / 8).cast("bigint").alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), F.col("f").cast("double").alias("v"))


@query(D.with_sql(PIX) + "select label, y, x, round(quantile_cont(v, 0.5), 6) as median, count(*) as images from pix group by all having count(*) >= 20")
def d46_median_composite(spark: SparkSession, d: str) -> DataFrame:
    """Median of each pixel over the images of a class (the selection), if enough show it."""
    p = _pixels(spark, d).withColumn("y", F.struct("label", "y"))
    return I.median_composite(p, 20).select("y.label", "y.y", "x", F.round("median", 6).alias("median"), "images")


@query()
def d47_footprint(spark: SparkSession, d: str) -> DataFrame:
    return I.footprint_mask(tiles(spark, d))


@query(D.with_sql(PIX) + "select vec_id, round(sum(case when y between 1 and 6 and x between 1 and 6 then ln(1 + greatest(v, 0)) / 2 else 0 end), 6) as cropped_sum, round(0.1::double / 10 + 0.9::double * (case when label = 0 then 1 else 0 end), 6) as first_class from pix group by vec_id, label")
def d52_preprocessing(spark: SparkSession, d: str) -> DataFrame:
    """Log scale and divider, crop, one-hot labels smoothed."""
    t = tiles(spark, d)
    v = I.cropped(I.prepared(F.col("vals"), 2.0), 8, 1, 8)
    return t.select(F.col("tile_id").alias("vec_id"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("cropped_sum"), F.round(I.smoothed_labels(F.col("label"), 10)[0], 6).alias("first_class"))


@query()
def d53_augmentation(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of flipped, transposed, rolled and scaled tiles, with the length scaled alike."""
    a = I.augmented(tiles(spark, d).withColumn("length_m", 100.0 + F.col("label")), "length_m")
    return a.select("tile_id", F.posexplode("vals").alias("place", "v"), F.round("length", 6).alias("length_m")).withColumn("v", F.round("v", 6))


@query("select vec_id, round(greatest(a, 0) / (greatest(a, 0) + greatest(b, 0) + greatest(c, 0) + 3), 8) as score, round(300.0 / (1 + exp(-a)), 6) as length_m from (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)")
def d54_class_scores(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform(F.slice("vals", 1, 3), lambda x: F.greatest(x, F.lit(0.0)))
    return tiles(spark, d).select(F.col("tile_id").alias("vec_id"), F.round(I.evidence_scores(e)[0], 8).alias("score"), F.round(I.scaled_sigmoid(F.col("vals")[0], 300.0), 6).alias("length_m"))


@query(D.with_sql(PIX) + "select vec_id, round(avg(v), 6) as mean, round(max(v), 6) as peak from pix group by 1")
def d58_batched_inference(spark: SparkSession, d: str) -> DataFrame:
    """A model loaded once for each task, run over batches of tiles."""

    def load():
        return lambda x: np.stack([x.mean(axis=(1, 2)), x.max(axis=(1, 2))], axis=1)

    p = I.predicted(tiles(spark, d), load, ["mean", "peak"])
    return p.select(F.col("tile_id").alias("vec_id"), F.round("mean", 6).alias("mean"), F.round("peak", 6).alias("peak"))


@query()
def d43_greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of detections of one scene time within 40 m the first seen stays."""
    x = D.det(spark, d).where("scene_id is not null").withColumn("time", F.coalesce(scene_time(F.col("scene_id"), 1).cast("string"), F.col("scene_id")))
    return I.greedy_dedup(x.select("time", F.col("detect_id").alias("id"), "lat", "lon", "ts"), "time", 40.0, "ts")
