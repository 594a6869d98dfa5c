"""Matching vessels to detections: pings around an image, probability rasters, mutual-best assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import geo
from tidelane.functions.bins import minutes_bin, speed_bin, vessel_label
from tidelane.functions.compat import bq_int, safe_div
from tidelane.operators.proximity import distance_join
from tidelane.runtime import BROADCAST_ROWS, written

NM_M = 1852.0
#: Kilometres of a degree of latitude and of a nautical mile in the vessel's frame, and the raster's half width.
DEGREE_KM, NM_KM, HALF = 111.699, 1.852, 500.0


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it holds few rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns, each computed once: the optimiser doesn't copy their expressions into later ones, which keeps generated code small."""
    names = [c for c in df.columns if c not in cols]
    return df.select(*names, F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def neighbours_in_time(ping: DataFrame, *more: str) -> DataFrame:
    """ping with ts_before and ts_after in its segment, and next_<c> for each further column."""
    w = Window.partitionBy("seg_id").orderBy("ts")
    out = ping.withColumns({"ts_before": F.lag("ts").over(w), "ts_after": F.lead("ts").over(w)})
    return out.withColumns({f"next_{c}": F.lead(c).over(w) for c in more}) if more else out


def minutes(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, in minutes."""
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000) / 60.0


def around_image(ping: DataFrame, det: DataFrame, most_minutes: float = 540.0, radius_m: float = 100 * NM_M) -> DataFrame:
    """Pings just before or just after a detection's instant within the time and distance: a time bucket as wide as the limit joins the cells' keys.

    ping: as neighbours_in_time() gives it. Adds detect_id, scene_id, detect_ts, r_lat, r_lon, delta_minutes, previous_exists, after_exists.
    """
    width = int(most_minutes * 60)
    p = ping.withColumn("__k", F.floor(F.unix_micros("ts") / 1_000_000 / width).cast("bigint"))
    home = F.floor(F.unix_micros("ts") / 1_000_000 / width).cast("bigint")
    q = det.where("ts is not null").select("detect_id", "scene_id", "lat", "lon", F.col("ts").alias("detect_ts"), F.explode(F.array(home - 1, home, home + 1)).alias("__k"))
    met = distance_join(p, q, radius_m, inclusive=False, on=("__k",)).drop("__k")
    at, ts, before, after = F.col("detect_ts"), F.col("ts"), F.col("ts_before"), F.col("ts_after")
    delta = minutes(ts, at)
    beside = ((ts <= at) & (after > at)) | ((ts <= at) & after.isNull()) | ((ts > at) & (before <= at)) | ((ts > at) & before.isNull())
    met = computed(met, delta_minutes=delta).where((F.abs("delta_minutes") < most_minutes) & beside)
    near = lambda c: F.coalesce(F.abs(minutes(c, at)) < most_minutes, F.lit(False))
    return met.withColumns({"previous_exists": near(before), "after_exists": near(after)})


def satellite_motion(foot: DataFrame) -> DataFrame:
    """(scene_id, sat_course, sat_knots, the track's ends, altitude_m): course on a plane, ground speed raised to the orbit's height."""
    lat0, lon0, lat1, lon1 = (F.col(c) for c in ("sat_lat0", "sat_lon0", "sat_lat1", "sat_lon1"))
    north, east = (lat1 - lat0) * 111, (lon1 - lon0) * 111 * F.cos(F.radians(lat1 / 2 + lat0 / 2))
    seconds = F.unix_seconds("end_time") - F.unix_seconds("start_time")
    r = geo.earth_radius_km(lat1)
    speed = geo.haversine_m(lat0, lon0, lat1, lon1) * (r + F.col("altitude_m") / 1000) / r
    return foot.select("scene_id", F.degrees(F.atan2(east, north)).alias("sat_course"), (speed / seconds * 3600 / NM_M).alias("sat_knots"), "sat_lat0", "sat_lon0", "sat_lat1", "sat_lon1", "altitude_m")


def doppler_shifted(met: DataFrame, motion: DataFrame) -> DataFrame:
    """met with lat, lon moved to where the radar would show the vessel's ping."""
    m = met.join(motion, "scene_id")
    lat_i, lon_i = geo.dead_reckon(F.col("lat"), F.col("lon"), F.col("course"), F.col("speed"), F.col("delta_minutes"))
    m = computed(m, lat_i=lat_i, lon_i=lon_i)
    m = m.withColumn("lon_i", geo.near_lon(F.col("lon_i")))
    ground = geo.segment_distance_m(F.col("lat_i"), F.col("lon_i"), F.col("sat_lat0"), F.col("sat_lon0"), F.col("sat_lat1"), F.col("sat_lon1")) / NM_M
    slant = F.sqrt(F.pow(ground, 2) + F.pow(F.col("altitude_m") / NM_M, 2))
    m = computed(m, adj=geo.doppler_offset_nm(F.col("speed"), F.col("course"), F.col("sat_course"), F.col("sat_knots"), slant))
    c = F.radians("sat_course")
    return computed(m, lat=F.col("lat") - F.col("adj") * F.cos(c) / 60, lon=F.col("lon") - F.col("adj") * F.sin(c) / (60 * F.cos(F.radians("lat"))))


def frame_keys(m: DataFrame) -> DataFrame:
    """m with scale, x_key, y_key: the detection (r_lat, r_lon) in the vessel's frame, straight-ahead motion taken out, clipped to the raster."""
    u = DEGREE_KM * (F.col("r_lon") - F.col("lon")) * F.cos(F.radians("lat"))
    v = DEGREE_KM * (F.col("r_lat") - F.col("lat"))
    c = F.radians("course")
    scale = 1000 / F.greatest(F.lit(1.0), F.abs("delta_minutes"))
    m = computed(m, scale=scale)
    x = (F.cos(c) * u - F.sin(c) * v) * F.col("scale")
    y = (F.cos(c) * v + F.sin(c) * u - F.col("speed") * NM_KM * F.col("delta_minutes") / 60) * F.col("scale")
    return computed(m, x_key=x, y_key=y).where((F.abs("x_key") <= HALF) & (F.abs("y_key") <= HALF))


def composite_raster(raster: DataFrame, name: str = "fishing", of: tuple[str, ...] = ("trawlers", "purse_seines", "drifting_longlines")) -> DataFrame:
    """raster with a class that is the mean of others."""
    mean = raster.where(F.col("labels").isin(*of)).groupBy("minutes_lower", "speed_lower", "i", "j").agg(F.avg("probability").alias("probability"))
    return raster.unionByName(mean.withColumn("labels", F.lit(name)))


def raster_weights(raster: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weight): the sum of squared probabilities over the whole raster, of which i >= 0 is stored."""
    return raster.groupBy(*keys).agg(F.sum(F.when(F.col("i") > 0, 2.0).otherwise(1.0) * F.pow("probability", 2)).alias("weight"))


def raster_lookup(m: DataFrame, raster: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """m with probability, interpolated between the four cells around (x_key, y_key), and weight; a missing cell has zero.

    Each corner is a join on the raster's key, against a table that is broadcast if its counted size allows; rows of m
    stay where they are and are not regrouped. The raster is symmetrical in i, so |i| looks it up and no mirrored copy is made.
    """
    x, y = F.col("x_key") / cell, F.col("y_key") / cell
    x1, x2, y1, y2 = bq_int(x - 0.5), bq_int(x + 0.5), bq_int(y - 0.5), bq_int(y + 0.5)
    fx, fy = (x - x1) / (x2 - x1), (y - y1) / (y2 - y1)
    four = ((x1, y1, (1 - fx) * (1 - fy)), (x2, y1, fx * (1 - fy)), (x1, y2, (1 - fx) * fy), (x2, y2, fx * fy))
    side = small(raster.select(*keys, F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("probability").alias("__p")))
    total, out = None, m
    for k, (i, j, share) in enumerate(four):
        out = out.withColumns({"__i": F.abs(i), "__j": j}).join(side.withColumnRenamed("__p", f"__p{k}"), [*keys, "__i", "__j"], "left").drop("__i", "__j")
        part = F.coalesce(F.col(f"__p{k}") * share, F.lit(0.0))
        total = part if total is None else total + part
    out = out.select(*m.columns, total.alias("probability"))
    return out.join(small(raster_weights(raster, keys)), keys, "left")


def pair_pings(m: DataFrame, value: list[str]) -> DataFrame:
    """Per vessel and detection: the ping after it with the one before (a_*, b_*), or the only one; a lone row whose partner should exist is dropped."""
    keys = ["ssvid", "detect_id"]
    a = m.select(*keys, "scene_id", "ts", "previous_exists", "after_exists", *[F.col(c).alias(f"a_{c}") for c in value])
    b = m.select(*keys, F.col("ts").alias("b_ts"), *[F.col(c).alias(f"b_{c}") for c in value])
    both = a.join(b, (a.ssvid == b.ssvid) & (a.detect_id == b.detect_id) & (a.ts > b.b_ts), "left").drop(b.ssvid).drop(b.detect_id)
    return both.where(~(F.col("b_ts").isNull() & (F.col("previous_exists") | F.col("after_exists"))))


def score_pings(ping: DataFrame, det: DataFrame, foot: DataFrame, raster: DataFrame, vessel: DataFrame | None, cell: float = 1.0) -> DataFrame:
    """(ssvid, scene_id, detect_id, score > 0): the weighted mean of the raster's probabilities for the pings before and after the image.

    With vessels the raster is keyed by class too; without, by speed and minutes alone.
    """
    p = neighbours_in_time(ping.where("speed < 50"))
    if vessel is not None:
        p = p.join(small(vessel.select("ssvid", vessel_label(F.col("best_class")).alias("labels"))), "ssvid")
    m = frame_keys(doppler_shifted(around_image(p, det), satellite_motion(foot)))
    keys = ["labels", "minutes_lower", "speed_lower"] if vessel is not None else ["minutes_lower", "speed_lower"]
    m = m.withColumns({"minutes_lower": minutes_bin(F.col("delta_minutes")), "speed_lower": speed_bin(F.col("speed"))})
    m = m.select("ssvid", "detect_id", "scene_id", "seg_id", "ts", "previous_exists", "after_exists", "scale", "x_key", "y_key", *keys)
    m = raster_lookup(m, raster, keys, cell)
    m = m.withColumn("w", F.coalesce(F.col("weight") / (F.col("scale") * F.col("scale")), F.lit(0.0)))
    z = pair_pings(m, ["probability", "w"]).fillna(0.0, ["a_probability", "b_probability", "a_w", "b_w"])
    score = safe_div(F.col("a_probability") * F.col("a_w") + F.col("b_probability") * F.col("b_w"), F.col("a_w") + F.col("b_w"))
    return z.select("ssvid", "scene_id", "detect_id", score.alias("score")).where("score > 0")


def rank_pairs(df: DataFrame, left: list[str], right: list[str], score: str = "score", names: tuple[str, str] = ("rank_left", "rank_right")) -> DataFrame:
    """df with each pair's rank for its left and right partner: best score first, then keys, so ranks are unique."""
    order = [F.desc(score), *[F.col(c) for c in dict.fromkeys([*left, *right])]]
    return df.withColumns({n: F.row_number().over(Window.partitionBy(*side).orderBy(*order)) for n, side in zip(names, (left, right))})


def mutual_best(df: DataFrame, left: list[str], right: list[str], score: str = "score", rounds: int = 4) -> DataFrame:
    """df's pairs that are first for both partners, with the round; both partners leave before the next round. One-to-one.

    A partner's best pair is an aggregate, so no side is sorted as a whole. Each round is written, which cuts the plan.
    """
    keys = list(dict.fromkeys([*left, *right]))
    rest, out = df.where(F.col(score).isNotNull()), None
    for r in range(1, rounds + 1):
        # the least of (falling score, keys): ties go to the smaller keys
        best = F.min(F.struct((-F.col(score)).alias("fall"), *keys)).alias("b")
        one = rest.groupBy(*left).agg(best).select(*[F.col(f"b.{k}").alias(k) for k in keys]).intersect(rest.groupBy(*right).agg(best).select(*[F.col(f"b.{k}").alias(k) for k in keys]))
        got, _ = written(rest.join(one, keys, "left_semi").withColumn("round", F.lit(r)), f"matched{r}")
        out = got if out is None else out.unionByName(got)
        if r < rounds:
            rest, _ = written(rest.join(got.select(*left), left, "left_anti").join(got.select(*right), right, "left_anti"), f"open{r}")
    return out


def confidence(df: DataFrame, left: list[str], right: list[str], score: str = "score") -> DataFrame:
    """df with score over the root of both partners' total scores."""
    a, b = (F.sum(score).over(Window.partitionBy(*side)) for side in (left, right))
    return df.withColumn("confidence", safe_div(F.col(score), F.sqrt(a * b)))


def cells_of_box(df: DataFrame, lat0: Column, lat1: Column, lon0: Column, lon1: Column, n: int, pad: int = 2) -> DataFrame:
    """df with a row for each cell (n to a degree) of a box and `pad` cells around it: lat_bin, lon_bin."""
    low, high = (F.floor(c * n).cast("bigint") for c in (lat0, lat1))
    left, right = (F.floor(c * n).cast("bigint") for c in (lon0, lon1))
    return df.withColumn("lat_bin", F.explode(F.sequence(low - pad, high + pad))).withColumn("lon_bin", F.explode(F.sequence(left - pad, right + pad)))


def ping_probability(df: DataFrame, raster: DataFrame, k: int, n: int, cell: float) -> DataFrame:
    """df (one row for each vessel image and cell) with p<k>, the raster's probability of the cell seen from ping k; rows outside the raster have none."""
    lat, lon = F.col(f"lat_adj{k}"), F.col(f"lon_adj{k}")
    u = DEGREE_KM * (F.col("lon_bin") / n - lon) * F.cos(F.radians(lat))
    v = DEGREE_KM * (F.col("lat_bin") / n - lat)
    c, s = F.radians(f"course{k}"), F.col(f"scale{k}")
    x, y = (F.cos(c) * u - F.sin(c) * v) * s, (F.cos(c) * v + F.sin(c) * u) * s
    inside = (F.abs(x) <= HALF) & (F.abs(y) <= HALF)
    keyed = df.withColumns({"labels": F.col("label"), "minutes_lower": minutes_bin(F.col(f"delta_minutes{k}")), "speed_lower": speed_bin(F.col(f"speed{k}")), "i": F.when(inside, F.abs(bq_int(x / cell))), "j": F.when(inside, bq_int(y / cell))})
    keys = ["labels", "minutes_lower", "speed_lower", "i", "j"]
    return keyed.join(small(raster.select(*keys, F.col("probability").alias(f"p{k}"))), keys, "left").drop(*keys)


def multiplied_cells(extrap: DataFrame, raster: DataFrame, n: int, cell: float, half_deg: float) -> DataFrame:
    """(ext_id, ssvid, scene_id, lat_bin, lon_bin, p): both pings' probabilities multiplied on the cells they share, or the one's of a single ping.

    Both are looked up on one row for each cell, so the cells of two pings are never joined.
    """
    lat0, lat1 = F.least("lat_adj1", "lat_adj2") - half_deg, F.greatest("lat_adj1", "lat_adj2") + half_deg
    lon0, lon1 = F.least("lon_adj1", "lon_adj2") - half_deg, F.greatest("lon_adj1", "lon_adj2") + half_deg
    grid = cells_of_box(extrap, lat0, lat1, lon0, lon1, n)
    both = ping_probability(ping_probability(grid, raster, 1, n, cell), raster, 2, n, cell)
    p = F.when(F.col("is_single"), F.coalesce("p1", "p2")).otherwise(F.col("p1") * F.col("p2"))
    return both.select("ext_id", "ssvid", "scene_id", "lat_bin", "lon_bin", p.alias("p")).where("p > 0")


def mass_scores(cells: DataFrame, places: DataFrame, scale: DataFrame) -> DataFrame:
    """(ext_id, detect_id, score, max_score, likelihood): a detection's share of the probability mass of its vessel's cells.

    places: ext_id, detect_id, lat_bin, lon_bin. likelihood is the share of the mass in cells that are no more likely.
    """
    at = places.join(cells.select("ext_id", "lat_bin", "lon_bin", F.col("p").alias("here")), ["ext_id", "lat_bin", "lon_bin"])
    g = at.select("ext_id", "detect_id", "here").join(cells.select("ext_id", "p"), "ext_id").groupBy("ext_id", "detect_id", "here").agg(
        F.sum("p").alias("mass"), F.max("p").alias("top"), F.sum(F.when(F.col("p") <= F.col("here"), F.col("p")).otherwise(0.0)).alias("below")
    ).join(scale, "ext_id")
    square = F.col("scale") * F.col("scale")
    return g.select("ext_id", "detect_id", (F.col("here") / F.col("mass") * square).alias("score"), (F.col("top") / F.col("mass") * square).alias("max_score"), (F.col("below") / F.col("mass")).alias("likelihood"))


def length_difference(vessel_m: Column, seen_m: Column) -> Column:
    """Relative difference of lengths in tenths (whole number)."""
    return F.floor(safe_div(vessel_m - seen_m, vessel_m) * 10).cast("bigint")


def length_prior(matched: DataFrame) -> DataFrame:
    """(frac10, probability): how often matches differ so much in length."""
    counts = matched.groupBy(length_difference(F.col("best_length_m"), F.col("length_m")).alias("frac10")).agg(F.count(F.lit(1)).alias("number")).where("frac10 is not null")
    total = counts.agg(F.sum("number").alias("total"))
    return counts.join(F.broadcast(total)).select("frac10", (F.col("number") / F.col("total")).alias("probability"))


def length_factor(probability: Column, known: Column) -> Column:
    """Prior of a pair's length difference: a small one if never seen, half the mean if the vessel's length is unknown."""
    return F.when(probability.isNotNull(), probability).when(~known, 0.09 * 0.5).otherwise(1e-6)


def sweep(df: DataFrame, thresholds: list[float], score: str = "score") -> DataFrame:
    """(threshold, matches): pairs above each threshold, from one pass."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    return df.select(score, t.alias("threshold")).groupBy("threshold").agg(F.count_if(F.col(score) > F.col("threshold")).alias("matches"))
