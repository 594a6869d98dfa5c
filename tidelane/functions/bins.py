"""Step maps, calendar bins and categories of detections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges of the probability rasters' minute bins, the vessel classes with rasters, the score threshold.
MINUTE_EDGES = [-384, -256, -192, -128, -96, -64, -48, -32, -24, -16, -12, -8, -6, -4, -3, -2, -1, 0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384]
FIRST_MINUTE = -512
SPEED_EDGES = [2, 4, 6, 8, 10]
VESSEL_CLASSES = {
    "drifting_longlines": "drifting_longlines",
    "purse_seines": "purse_seines",
    "other_purse_seines": "purse_seines",
    "tuna_purse_seines": "purse_seines",
    "cargo_or_tanker": "cargo_or_tanker",
    "cargo": "cargo_or_tanker",
    "tanker": "cargo_or_tanker",
    "tug": "tug",
    "trawlers": "trawlers",
}
MATCH_THRESHOLD = 7.4e-6
PERIOD_START = dt.date(2017, 1, 1)
PERIOD_DAYS = 24


def step(c: Column, first: int, edges: list[int]) -> Column:
    """The largest edge at or below c, or `first` below all; null for null."""
    out = F.when(c < edges[0], first)
    for low, high in zip(edges, edges[1:]):
        out = out.when(c < high, low)
    return out.when(c >= edges[-1], edges[-1]).cast("bigint")


def speed_bin(c: Column) -> Column:
    return step(c, 0, SPEED_EDGES)


def minutes_bin(c: Column) -> Column:
    return step(c, FIRST_MINUTE, MINUTE_EDGES)


def vessel_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in VESSEL_CLASSES.items() for x in pair])
    return F.coalesce(F.element_at(table, c), F.lit("other"))


def length_bin(c: Column) -> Column:
    """Centre of a length bin of 2 m (under 30), 4 m (under 60), 20 m (over 60, under 200) or 200; -20 for null and for exactly 60."""
    return (
        F.when(c < 30, F.floor(c / 2) * 2 + 1)
        .when((c >= 30) & (c <= 59.9999999), F.floor(c / 4) * 4 + 2)
        .when((c > 60) & (c < 200), F.floor(c / 20) * 20 + 10)
        .when(c >= 200, 200)
        .otherwise(-20)
        .cast("bigint")
    )


def distance_bin(c: Column) -> Column:
    """Lower edge of a 100 m bin, 1000 from there on and for null."""
    return F.when(c < 1000, F.floor(c / 100) * 100).otherwise(1000).cast("bigint")


def period24(c: Column) -> Column:
    """First day of the 24-day period that holds a date or timestamp."""
    days = F.datediff(c.cast("date"), F.lit(PERIOD_START))
    return F.date_add(F.lit(PERIOD_START), (F.floor(days / PERIOD_DAYS) * PERIOD_DAYS).cast("int"))


def pseudo_quarter(c: Column) -> Column:
    """year * 10 + quarter 0 to 3 of the year by day."""
    return (F.year(c) * 10 + F.floor(F.dayofyear(c) / 366.5 * 4)).cast("bigint")


def nearest_month(c: Column) -> Column:
    """First of the month, or of the next one after the 15th."""
    first = F.trunc(c.cast("date"), "month")
    return F.when(F.dayofmonth(c) > 15, F.add_months(first, 1)).otherwise(first)


def fractional_year(c: Column) -> Column:
    year = F.year(c)
    size = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return year + (F.dayofyear(c) - 1) / size


def reset_window(c: Column) -> Column:
    """True on the days that start a non-overlapping 24-day window counted from 13 January of their year."""
    return F.datediff(F.make_date(F.year(c), F.lit(1), F.lit(13)), c.cast("date")) % PERIOD_DAYS == 0


def matched_category(score: Column, on_fishing_list: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    """Null where the score is null or equals the threshold."""
    above = score > threshold
    return (
        F.when(above & on_fishing_list, "matched_fishing").when(above & ~on_fishing_list, "matched_nonfishing")
        .when(above & on_fishing_list.isNull(), "matched_unknown").when(score < threshold, "unmatched")
    )


def hash32(key: Column, seed: int = 0) -> Column:
    """A number below 2^32 for each key, by a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) for each key."""
    return hash32(key, seed) / float(1 << 32)


def dithered_category(category: Column, fishing: Column, draw: Column) -> Column:
    """Fishing or not by a draw: unknown vessels and unmatched detections split by score. Unknown ones whose draw lies at or under a score below one half stay without a category."""
    return (
        F.when(category == "matched_fishing", "matched_fishing").when(category == "matched_nonfishing", "matched_nonfishing")
        .when((category == "matched_unknown") & (fishing > 0.5), "matched_fishing").when((category == "matched_unknown") & (fishing < draw), "matched_nonfishing")
        .when((category == "unmatched") & (fishing > draw), "unmatched_fishing").when(category == "unmatched", "unmatched_nonfishing")
    )


def detect_id_text(scene_id: Column, lon: Column, lat: Column) -> Column:
    """scene;lon;lat with longitudes of 11 and latitudes of 10 characters, filled with zeros on the right."""
    return F.concat_ws(";", scene_id, F.rpad(F.format_string("%.6f", lon), 11, "0"), F.rpad(F.format_string("%.6f", lat), 10, "0"))


def scene_time(scene_id: Column, which: int = 1) -> Column:
    """Start (1) or end (2) in a scene id, as a timestamp; null where there is none."""
    text = F.regexp_extract(scene_id, r"_(\d{8}T\d{6})_(\d{8}T\d{6})_", which)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))
