"""The hub table of detections: scene quality, repeated objects, categories and effort-normalised densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.bins import matched_category
from tidelane.functions.boxes import free_of_ice
from tidelane.functions.compat import safe_div
from tidelane.operators.proximity import distance_join

CATEGORIES = ("matched_fishing", "matched_nonfishing", "matched_unknown")


def scene_quality(det: DataFrame, scene: str = "scene_id", presence: str = "presence", least: float = 0.7) -> DataFrame:
    """(scene, scene_detections, scene_quality): one less the share of detections with low or no presence."""
    bad = F.coalesce(F.col(presence) < least, F.lit(True))
    return det.groupBy(scene).agg(F.count(F.lit(1)).alias("scene_detections"), (1 - F.avg(bad.cast("double"))).alias("scene_quality"))


def repeats(det: DataFrame, radius_m: float = 100.0, days: int = 180) -> DataFrame:
    """(detect_id, repeats_center, repeats_forward, repeats_back): other detections closer than the radius within half the days on either side, the days ahead, the days before.

    det: detect_id, lat, lon, ts. One pass of the cell join gives all three counts; detections without any have zeros.
    """
    p = det.where("ts is not null").select("detect_id", "lat", "lon", F.unix_micros("ts").alias("t"))
    near = distance_join(p, p, radius_m, inclusive=False).where("detect_id <> r_detect_id")
    gap = F.col("r_t") - F.col("t")
    day = 86_400_000_000
    counts = near.groupBy("detect_id").agg(
        F.count_if(F.abs(gap) <= days // 2 * day).alias("repeats_center"), F.count_if(gap.between(0, days * day)).alias("repeats_forward"), F.count_if(gap.between(-days * day, 0)).alias("repeats_back")
    )
    return det.select("detect_id").join(counts, "detect_id", "left").fillna(0)


def ensemble(pred: DataFrame) -> DataFrame:
    """(detect_id, fishing_low, fishing, fishing_high): the mean over models."""
    return pred.groupBy("detect_id").agg(F.avg("fishing_33").alias("fishing_low"), F.avg("fishing_50").alias("fishing"), F.avg("fishing_66").alias("fishing_high"))


def close_to(det: DataFrame, structures: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """(detect_id) of detections with a structure (lat, lon) within the radius."""
    return distance_join(det.select("detect_id", "lat", "lon"), structures.select("lat", "lon").distinct(), radius_m, inclusive=False).select("detect_id").distinct()


def potential_ambiguities(candidates: DataFrame, most_m: float = 200.0) -> DataFrame:
    """(detect_id) of candidates (detect_id, line_dist, ambiguity_length, source_length) near the line of a longer source."""
    return candidates.where((F.col("line_dist") < most_m) & (F.col("ambiguity_length") < F.col("source_length"))).select("detect_id").distinct()


def quality_filter(hub: DataFrame, least_overpasses: int = 30, most_repeats: int = 3, first: str = "2017-01-01", last: str = "2021-12-31") -> DataFrame:
    """Keeps detections of the period that are few at their place, from good or nearly empty scenes, in well-imaged cells, likely real, free of ice, and neither on a road, nor at a structure, nor a likely ambiguity."""
    few = (F.col("repeats_forward") < most_repeats) & (F.col("repeats_back") < most_repeats) & (F.col("repeats_center") < most_repeats)
    good = (F.col("scene_detections") <= 5) | (F.col("scene_quality") > 0.5)
    real = ~F.col("in_road") & ~F.col("close_to_infra") & ~F.col("potential_ambiguity")
    within = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return hub.where(few & good & within & (F.col("overpasses") > least_overpasses) & (F.col("presence") > 0.7) & real & free_of_ice(F.col("lon"), F.col("lat")))


def hub_table(det: DataFrame, cells: DataFrame, structures: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """det with repeats, scene quality, what is known of its cell (overpasses, years with an overpass, depth, distance to shore, in_road) and the flags close_to_infra and potential_ambiguity."""
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    out = (
        det.join(repeats(det), "detect_id").join(scene_quality(det), "scene_id", "left").join(cells, ["lat_index", "lon_index"], "left")
        .join(flag(close_to(det, structures), "close_to_infra"), "detect_id", "left").join(flag(potential_ambiguities(ambiguities), "potential_ambiguity"), "detect_id", "left")
    )
    return out.fillna(False, ["in_road", "close_to_infra", "potential_ambiguity"])


def classify(hub: DataFrame, vessel: DataFrame, pred: DataFrame) -> DataFrame:
    """Kept detections with fishing scores and matched_category."""
    out = quality_filter(hub).join(vessel.select("ssvid", "on_fishing_list"), "ssvid", "left").join(ensemble(pred), "detect_id", "left")
    return out.withColumn("matched_category", matched_category(F.col("score"), F.col("on_fishing_list")))


def density_fields(effort: str = "overpasses") -> list[Column]:
    """Detections for each overpass by category, those of unknown vessels and unmatched ones split by fishing score, low and high included."""
    w = safe_div(F.lit(1), F.col(effort))
    cat = F.col("matched_category")

    def total(c: str, value: Column, name: str) -> Column:
        return F.sum(F.when(cat == c, value).otherwise(0.0)).alias(name)

    out = [total(c, w, c) for c in CATEGORIES]
    for end in ("", "_low", "_high"):
        s = F.col("fishing" + end)
        out += [
            total("matched_unknown", s * w, f"matched_unknown_likelyfish{end}"), total("matched_unknown", (1 - s) * w, f"matched_unknown_likelynonfish{end}"),
            total("unmatched", s * w, f"unmatched_fishing{end}"), total("unmatched", (1 - s) * w, f"unmatched_nonfishing{end}"),
        ]
    return [*out, F.sum(w).alias("detections")]
