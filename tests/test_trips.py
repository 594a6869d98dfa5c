import datetime as dt

import numpy as np
import pytest

from tidelane.operators import trips as T

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "seg_id string, ping_timestamp timestamp, lat double, lon double"


def track(*legs, seg="a", every=300, at=(10.0, 20.0), seed=0):
    """Legs: ('stop', pings) or ('move', pings); rows in order."""
    rng = np.random.default_rng(seed)
    lat, lon = at
    rows, t = [], 0
    for kind, n in legs:
        for _ in range(n):
            if kind == "move":
                lat += 0.015
            rows.append((seg, T0 + dt.timedelta(seconds=t), lat + rng.normal(0, 2e-4), lon + rng.normal(0, 2e-4)))
            t += every
    return rows


def found(spark, rows, **kw):
    out = T.stops_and_trips(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted((r.device, r.kind, (r.start_us / 1e6 - T0.replace(tzinfo=dt.timezone.utc).timestamp()) / 300, (r.end_us / 1e6 - T0.replace(tzinfo=dt.timezone.utc).timestamp()) / 300) for r in out)


def test_stop_between_trips(spark):
    got = found(spark, track(("move", 20), ("stop", 30), ("move", 20)))
    assert got == [("a", "stop", 19, 49), ("a", "trip", 0, 19), ("a", "trip", 49, 69)]


def test_short_halt_belongs_to_the_trip(spark):
    assert found(spark, track(("move", 20), ("stop", 8), ("move", 20))) == [("a", "trip", 0, 47)]


def test_faulty_positions_do_not_end_a_stop(spark):
    rows = track(("move", 5), ("stop", 40), ("move", 5))
    for k in (20, 21, 30):
        rows[k] = (*rows[k][:2], 0.0, 0.0)
    assert found(spark, rows) == [("a", "stop", 4, 44), ("a", "trip", 0, 4), ("a", "trip", 44, 49)]
    rows[22] = (*rows[22][:2], 0.0, 0.0)  # three in a row end it
    assert [g for g in found(spark, rows) if g[1] == "stop"] == [("a", "stop", 4, 19), ("a", "stop", 23, 44)]


def test_silence_ends_everything(spark):
    rows = track(("stop", 20))
    later = [(s, t + dt.timedelta(hours=14), a, o) for s, t, a, o in rows]
    got = found(spark, rows + later)
    assert [g[1] for g in got] == ["stop", "stop"]


def test_dirty_rows(spark):
    rows = track(("move", 10), ("stop", 30))
    dirty = [(None, T0, 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", T0, None, 1.0), ("a", T0, 91.0, 181.0), ("a", T0, float("nan"), 1.0), ("b", T0, 5.0, 5.0)]
    assert found(spark, rows + rows + dirty) == [*found(spark, rows), ("b", "trip", 0, 0)]


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame(track(("stop", 30)), SCHEMA).selectExpr("*", "1 as device", "2 as t", "3 as kind", "4 as slice")
    assert T.stops_and_trips(df).count() == 1


@pytest.mark.parametrize("hot_rows", [5, 40, 100])
def test_hot_device_is_split_without_a_difference(spark, hot_rows):
    rows = track(("move", 30), ("stop", 120), ("move", 25), ("stop", 5), ("move", 25), ("stop", 400), ("move", 30), seed=3) + track(("move", 10), ("stop", 20), seg="b")
    assert found(spark, rows, hot_rows=hot_rows) == found(spark, rows)


@pytest.mark.parametrize("every", [10, 60, 300])
def test_dense_moving_device_passes_on_little(spark, every):
    """At any density a moving vessel's slices settle nearly all, with the same result as unsplit."""
    rng = np.random.default_rng(every)
    rules = (250.0, 3.6e9, 12 * 3.6e9, 2, 0.5)
    n = 20_000
    step = 5.1 * every * rng.normal(1, 0.05, n)  # 10 knots
    for a in (4000, 11_000):
        step[a : a + 5400 // every + 1] = 0  # stops of an hour and a half
    lat = np.cumsum(step) / 111_194.9 + rng.normal(0, 1e-4, n)
    t = np.arange(n) * every * 1_000_000
    assert len(T._slice_items(t, lat % 60, np.full(n, 7.0), rules)) < 0.05 * n
    few = slice(0, 6000)
    df = spark.createDataFrame([("a", T0 + dt.timedelta(microseconds=int(u)), float(v), 7.0) for u, v in zip(t[few], lat[few])], SCHEMA)
    key = lambda r: (r.kind, r.start_us, r.end_us, r.pings)
    whole = sorted(map(key, T.stops_and_trips(df).collect()))
    assert sorted(map(key, T.stops_and_trips(df, hot_rows=1000).collect())) == whole and [k[0] for k in whole].count("stop") == 1


def test_cuts_cross_no_stop():
    """On wandering tracks with faulty positions, no cut lies within a stop of the unsplit track."""
    rng = np.random.default_rng(8)
    rules = (250.0, 3.6e9, 12 * 3.6e9, 2, 0.5)
    crossed = cuts = 0
    for _ in range(20):
        n = 3000
        speed = np.repeat(rng.choice([0.0, 0.05, 0.3, 5.0], 30), 100)
        x = np.cumsum(speed * 60 * rng.normal(1, 0.1, n)) + rng.normal(0, 15, n)
        x[rng.random(n) < 0.03] += 9000
        t = np.cumsum(rng.integers(30, 90, n)) * 1_000_000
        y = rng.normal(0, 15, n)
        at = T._cuts(t, x, y, 0, n - 1, rules)
        cuts += at.sum()
        crossed += sum(at[a:b].sum() for a, b, _ in T.find_stops(t, x, y, np.ones(n), rules))
    assert cuts > 1000 and crossed == 0


@pytest.mark.parametrize("around", [100, 1500])
def test_short_stop_in_a_long_track(spark, around):
    rows = track(("move", around), ("stop", 13), ("move", around))
    assert [g[1:] for g in found(spark, rows) if g[1] == "stop"] == [("stop", around - 1, around + 12)]


def test_one_short_stop_is_found_whatever_the_length():
    rng = np.random.default_rng(2)
    for n, every, knots, stay in ((800, 300, 10, 13), (6000, 300, 10, 13), (6000, 600, 12, 7), (6000, 300, 6, 13)):
        step = knots * 1852 / 3600 * every * rng.normal(1, 0.05, n)
        step[n // 2 : n // 2 + stay] = 0
        x = np.cumsum(step) + rng.normal(0, 20, n)
        t = np.arange(n) * every * 1_000_000
        stops = T.find_stops(t, x, rng.normal(0, 20, n), np.ones(n), (250.0, 3.6e9, 12 * 3.6e9, 2, 0.5))
        assert [(a, b) for a, b, _ in stops] == [(n // 2 - 1, n // 2 + stay - 1)]


def test_date_line(spark):
    rows = [("a", T0 + dt.timedelta(minutes=5 * k), 0.0, 179.9999 if k % 2 else -179.9999) for k in range(30)]
    assert [g[1] for g in found(spark, rows)] == ["stop"]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    legs = []
    for _ in range(12):
        legs += [("move", int(rng.integers(5, 30))), ("stop", int(rng.integers(2, 60)))]
    rows = track(*legs, seed=9)
    la, lo = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    x, y = lo * 111194.9 * np.cos(np.radians(la.mean())), la * 111194.9
    stops, i = [], 0
    while i < len(rows):  # the longest run from each place on that has all pings in reach of its mean
        j = i + 1
        best = i
        while j < len(rows) and np.hypot(x[j] - x[i], y[j] - y[i]) <= 500:
            if np.hypot(x[i : j + 1] - x[i : j + 1].mean(), y[i : j + 1] - y[i : j + 1].mean()).max() <= 250:
                best = j
            j += 1
        if (best - i) * 300 >= 3600:
            stops.append((i, best))
            i = best + 1
        else:
            i += 1
    assert [(g[2], g[3]) for g in found(spark, rows) if g[1] == "stop"] == stops


def test_changepoints_find_steps():
    s = np.concatenate([np.zeros(20), np.ones(15), np.zeros(10)])[:, None]
    assert T.changepoints(s, 0.5) == [0, 20, 35]


def test_hull():
    x, y = np.array([0, 1, 1, 0, 0.5]), np.array([0, 0, 1, 1, 0.5])
    assert T.convex_hull(x, y).tolist() == [0, 1, 2, 3]
