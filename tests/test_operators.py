import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import clusters as C
from tidelane.operators import evaluation as E
from tidelane.operators import images as I
from tidelane.operators import matching as M
from tidelane.operators import series as S
from tidelane.runtime import salted_join


def test_mutual_best(spark):
    rows = [("v1", "d1", 9.0), ("v1", "d2", 8.0), ("v2", "d1", 7.0), ("v2", "d2", 6.0), ("v3", "d3", None), ("v4", "d4", 5.0), ("v5", "d4", 5.0)]
    got = M.mutual_best(spark.createDataFrame(rows, "v string, d string, score double"), ["v"], ["d"]).collect()
    assert sorted((r.v, r.d, r["round"]) for r in got) == [("v1", "d1", 1), ("v2", "d2", 2), ("v4", "d4", 1)]


def test_rolling_bounds(spark):
    df = spark.createDataFrame([(dt.date(2020, 6, 15),)], "d date")
    got = S.rolling_expand(df, "d", 11, 12).agg(F.min("rolling_date"), F.max("rolling_date"), F.count("*")).first()
    assert tuple(got) == (dt.date(2020, 6, 4), dt.date(2020, 6, 27), 24)


@pytest.mark.parametrize("values,want", [([None, 2.0, None, 4.0, None], [2.0, 2.0, 3.0, 4.0, 4.0]), ([None, 0.0, None], [None, 0.0, None])])
def test_interpolation(spark, values, want):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=k), v) for k, v in enumerate(values)]
    df = S.interpolate_gaps(spark.createDataFrame(rows, "k string, t date, v double"), ["k"], "t", "v", F.col("v").isNotNull())
    assert [r.v_i for r in df.orderBy("t").collect()] == want


def test_trend_solver():
    y = np.sin(np.arange(50)) + np.arange(50)
    d = np.diff(np.eye(50), 2, axis=0)
    assert np.allclose(S.hodrick_prescott(y, 100.0), np.linalg.solve(np.eye(50) + 100 * d.T @ d, y))


def test_sessions(spark):
    rows = [(1, dt.date(2020, m, 1)) for m in (1, 2, 4, 5, 9, 10)] + [(2, dt.date(2020, 1, 1))]
    got = C.lifetimes(spark.createDataFrame(rows, "c int, m date"), "c", "m").orderBy("midpoint").collect()
    assert [(r.subcluster, r.midpoint.month, r.seen) for r in got] == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (1, 5, True), (2, 9, True), (2, 10, True)]


def test_dbscan_chain(spark):
    step = 40 / 111194.9
    rows = [(k, k * step, 0.0) for k in range(30)] + [(99, 5.0, 5.0)]
    p = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    assert {r.cluster for r in C.dbscan(p, 50.0, 1).collect()} == {0, 99}
    assert {(r.id == 99, r.cluster) for r in C.dbscan(p, 50.0, 2).collect()} == {(False, 0), (True, None)}
    assert {r.cluster for r in C.dbscan(p, 50.0, 3).where("id < 99").collect()} == {1}


def test_auc_and_calibration(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5), (None, 0.3)], "y int, s double")
    assert E.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    t = E.calibration_table(E.reliability(df, "y", "s")).collect()
    assert len(t) == 101 and t[0].calibrated == 0.0 and t[100].calibrated == 1.0


def test_bright_regions(spark):
    a = np.ones((12, 12)) + np.random.default_rng(0).normal(0, 0.01, (12, 12))
    a[3:5, 3:5] = 9
    a[9, 9] = 7
    df = spark.createDataFrame([(1, 12, 12, a.ravel().tolist())], "tile_id int, height int, width int, vals array<double>")
    got = sorted((r["row"], r["col"], r.pixels) for r in I.detect(df, inner=2, outer=4, k=3.0).collect())
    assert got == [(3.5, 3.5, 4), (9.0, 9.0, 1)]


def test_dedup_and_box_sum(spark):
    a = np.arange(12.0).reshape(3, 4)
    assert I.box_sum(a, 1)[1, 1] == a[0:3, 0:3].sum() and I.box_sum(a, 1)[0, 0] == a[0:2, 0:2].sum()
    rows = [("s", "a", 0.0, 0.0, 1.0), ("s", "b", 0.0002, 0.0, 2.0), ("s", "c", 0.0006, 0.0, 3.0), ("t", "d", 0.0002, 0.0, 0.1)]
    got = I.greedy_dedup(spark.createDataFrame(rows, "g string, id string, lat double, lon double, p double"), "g", 40.0, "p").collect()
    assert sorted(r.id for r in got) == ["a", "c", "d"]


def test_salted_join_keeps_every_row(spark):
    left = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, n string")
    hot = spark.createDataFrame([(0, 7)], "k bigint, __salts int")
    assert salted_join(left, right, ["k"], F.col("v"), hot=hot).groupBy("n").count().orderBy("n").collect() == left.join(right, "k").groupBy("n").count().orderBy("n").collect()
    assert salted_join(left, right, ["k"], F.col("v"), "left", hot=hot).count() == 3000


def test_vessel_frame_symmetry(spark):
    """A detection straight ahead at the reckoned place has keys of zero."""
    rows = [(10.0, 20.0, 12.0, 90.0, 30.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, speed double, course double, delta_minutes double")
    lon = 20.0 + 12 * 0.5 * 1.852 / (111.699 * np.cos(np.radians(10.0)))
    k = M.frame_keys(df.withColumns({"r_lat": F.lit(10.0), "r_lon": F.lit(float(lon))})).first()
    assert abs(k.x_key) < 1e-6 and abs(k.y_key) < 1e-6


def test_footprint_and_outline(spark):
    assert I.outline(np.array([[1, 1], [1, 0]], bool)) == [[(0, 0), (0, 2), (1, 2), (1, 1), (2, 1), (2, 0), (0, 0)]]
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    assert sorted(map(len, I.outline(ring))) == [5, 5]
    corner = np.array([[1, 0], [0, 1]], bool)
    assert sum(len(r) - 1 for r in I.outline(corner)) == 8
    a = np.zeros((6, 6))
    a[1:5, 1:4] = 5.0
    a[5, 5] = 5.0  # apart from the rest
    df = spark.createDataFrame([(1, 6, 6, a.ravel().tolist())], "tile_id int, height int, width int, vals array<double>")
    got = I.footprint_mask(df).first()
    assert (got.valid, got.geometry) == (12, "POLYGON ((1 1, 1 5, 4 5, 4 1, 1 1))")


def test_augmentation_by_hash_of_the_id(spark):
    a = np.arange(64.0)
    ids = ["12", "21", "a", "b", "c", "d"]
    df = spark.createDataFrame([(i, 8, 8, a.tolist(), 10.0) for i in ids], "tile_id string, height int, width int, vals array<double>, m double")
    got = {r.tile_id: r for r in I.augmented(df, "m").collect()}
    assert got["12"].vals != got["21"].vals and len({tuple(r.vals) for r in got.values()}) == len(ids)
    assert {r.tile_id: r.vals for r in I.augmented(df.orderBy(F.desc("tile_id")), "m").collect()} == {i: r.vals for i, r in got.items()}
    assert all(8.0 <= r.length <= 12.5 and set(r.vals) <= {*a.tolist(), 0.0} for r in got.values())
    b = I.scaled_and_cropped(np.arange(16.0).reshape(4, 4), 2.0)
    assert b.tolist() == [[5, 5, 6, 6], [5, 5, 6, 6], [9, 9, 10, 10], [9, 9, 10, 10]]


def test_model_sees_full_batches(spark):
    seen = []

    def load():
        def model(x):
            assert len(x) == 4
            return x.sum(axis=(1, 2))[:, None]

        return model

    df = spark.createDataFrame([(k, 1, 2, [float(k), 1.0]) for k in range(7)], "tile_id int, height int, width int, vals array<double>").coalesce(1)
    assert sorted((r.tile_id, r.s) for r in I.predicted(df, load, ["s"], batch=4).collect()) == [(k, k + 1.0) for k in range(7)] and not seen


def test_despike_against_a_dense_solution(spark):
    rng = np.random.default_rng(0)
    y = np.sin(np.arange(200) / 30) * 5 + rng.normal(0, 0.1, 200)
    y[[20, 90, 150]] += 40
    want = y.copy()
    n = len(y)
    k = np.diff(np.eye(n), 2, axis=0)
    for _ in range(2):
        rest = want - np.linalg.solve(np.eye(n) + 129_600 * k.T @ k, want)
        bad = np.abs(rest) > 3 * rest.std()
        want[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), want[~bad])
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    df = spark.createDataFrame([("a", d, float(v)) for d, v in zip(days, y)], "k string, t date, v double")
    got = [r.clean for r in S.despike(df, "k", "t", "v").orderBy("t").collect()]
    assert np.allclose(got, want, atol=1e-6) and np.abs(np.array(got)[[20, 90, 150]]).max() < 10


def test_bootstrap_takes_the_season_off(spark):
    rng = np.random.default_rng(1)
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(4 * 365)]
    season = lambda d: 100 + 60 * np.sin(2 * np.pi * d.timetuple().tm_yday / 365)
    noise = np.zeros(len(days))
    for i in range(1, len(days)):
        noise[i] = 0.8 * noise[i - 1] + rng.normal(0, 2)
    df = spark.createDataFrame([("a", d, float(season(d) * (0.9 if d.year >= 2020 else 1) + e)) for d, e in zip(days, noise)] + [("b", days[0], 1.0)], "k string, t date, v double")
    (r,) = S.block_bootstrap(df, "k", "t", "v", dt.date(2020, 1, 1), reps=20_000).collect()
    assert abs(r.change + 10) < 1.5 and r.low < -10 < r.high and r.high - r.low < 6 and r.block > 2
    assert S.stationary_block_length(rng.normal(0, 1, 2000)) < 5 < S.stationary_block_length(noise)


def test_unfinished_components_raise(spark):
    edges = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(60)], "id_a string, id_b string")
    with pytest.raises(RuntimeError):
        C.labelled(edges, max_rounds=1)
    assert {r.label for r in C.labelled(edges).collect()} == {"000"}


def test_components_with_hot_vertices(spark, monkeypatch):
    """Stars and chains, with every vertex of some neighbours treated as hot."""
    monkeypatch.setattr("tidelane.operators.clusters.HOT_ROWS", 3)
    monkeypatch.setattr("tidelane.operators.clusters.HOT_SHARE", 0.0)
    edges = [("hub", f"s{k:02}") for k in range(25)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(20)] + [("s03", "z")]
    got = {r.id: r.label for r in C.labelled(spark.createDataFrame(edges, "id_a string, id_b string")).collect()}
    assert got == {v: ("c00" if v[0] == "c" else "hub") for e in edges for v in e}
