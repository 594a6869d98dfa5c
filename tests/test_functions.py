import datetime as dt

from pyspark.sql import functions as F

from tidelane.functions import bins, boxes, compat, geo


def one(spark, schema, row, *cols):
    return tuple(spark.createDataFrame([row], schema).select(*cols).first())


def test_rounding_casts(spark):
    got = [one(spark, "x double", (x,), compat.bq_int(F.col("x")))[0] for x in (2.5, -2.5, 3.5, -0.5)]
    assert got == [3, -3, 4, -1]


def test_strict_extremes(spark):
    c = [F.col(k) for k in "abc"]
    assert one(spark, "a int, b int, c int", (1, None, 3), compat.strict_greatest(*c), compat.strict_least(*c)) == (None, None)
    assert one(spark, "a int, b int, c int", (1, 2, 3), compat.strict_greatest(*c), compat.strict_least(*c)) == (3, 1)


def test_calendar(spark):
    d = dt.date
    assert one(spark, "a date, b date", (d(2020, 1, 31), d(2020, 2, 1)), compat.month_diff(F.col("a"), F.col("b")))[0] == 1
    assert one(spark, "a date, b date", (d(2020, 1, 1), d(2020, 3, 31)), compat.month_diff(F.col("a"), F.col("b")))[0] == 2
    p = [one(spark, "a date", (x,), bins.period24(F.col("a")))[0] for x in (d(2017, 1, 1), d(2017, 1, 24), d(2017, 1, 25), d(2016, 12, 31))]
    assert p == [d(2017, 1, 1), d(2017, 1, 1), d(2017, 1, 25), d(2016, 12, 8)]
    q = [one(spark, "a date", (x,), bins.pseudo_quarter(F.col("a")))[0] for x in (d(2020, 12, 31), d(2020, 1, 1))]
    assert q == [20203, 20200]


def test_length_bins(spark):
    got = [one(spark, "x double", (x,), bins.length_bin(F.col("x")))[0] for x in (29.0, 30.0, 59.9, 60.0, 61.0, 199.0, 200.0, None)]
    assert got == [29, 30, 58, -20, 70, 190, 200, -20]


def test_category(spark):
    c = bins.matched_category(F.col("s"), F.col("f"))
    got = [one(spark, "s double, f boolean", r, c)[0] for r in ((7.4e-6, True), (None, True), (1.0, True), (1.0, False), (1.0, None), (0.0, None))]
    assert got == [None, None, "matched_fishing", "matched_nonfishing", "matched_unknown", "unmatched"]


def test_longitudes(spark):
    assert [one(spark, "x double", (x,), geo.near_lon(F.col("x")))[0] for x in (181.0, -181.0, 180.0)] == [-179.0, 179.0, 180.0]
    assert [one(spark, "x double", (x,), geo.wrap_lon(F.col("x")))[0] for x in (541.0, -180.0, 180.0)] == [-179.0, -180.0, -180.0]
    assert abs(one(spark, "a double, b double", (179.0, -179.0), geo.mean_lon(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0)))[0]) == 180.0


def test_ice_box_across_the_date_line(spark):
    box = (130.5, 50.6, -174.2, 67.8)
    got = [one(spark, "x double, y double", (x, 60.0), boxes.in_box(F.col("x"), F.col("y"), box))[0] for x in (170.0, -175.0, -170.0, 0.0)]
    assert got == [True, True, False, False]


def test_steps(spark):
    assert [one(spark, "x double", (x,), bins.minutes_bin(F.col("x")))[0] for x in (-1000.0, -384.0, -0.5, 0.0, 383.9, 384.0, None)] == [-512, -384, -1, 0, 256, 384, None]
    assert [one(spark, "x double", (x,), bins.speed_bin(F.col("x")))[0] for x in (0.0, 2.0, 102.3)] == [0, 2, 10]


def test_detect_id_text(spark):
    assert one(spark, "s string, x double, y double", ("S", -2.5, 10.25), bins.detect_id_text(F.col("s"), F.col("x"), F.col("y")))[0] == "S;-2.50000000;10.2500000"
