"""Stops and trips from location pings.

Per device the track is cut at silences; within a piece, positions are filtered (running median), and the
filtered displacement and speed from ping to ping go through a penalised changepoint segmentation. Each segment
gets a mobility label from its displacement; stretches of pings that stay within reach of each other are labelled as
dwelling besides, since a short stop in a long track makes no segment. Dwelling segments are settled exactly: the longest run of pings
within a radius of their common centre, where short runs of faulty positions are bridged. Trips are the rest.

A device with more than `hot_rows` pings is split at time quantiles. Each slice settles what lies between two cuts
that no stop can span, and passes on only its two open edges, with long dwells in them reduced to hull points and a
weighted centre. A second pass per device joins the edges. A cut lies where, within half of min_stop_s on either side,
the device has left every place that a stop across the cut could be at; a device that moves over 4 radii in
min_stop_s has cuts however dense its pings are. One that creeps along for a whole slice, too slow for a cut and too
fast for a dwell, passes on all of that slice.

Defined results: no rows for an empty table; rows with null device, time or position, or an impossible position,
don't count; pings of one device at one instant count once (smallest lat, lon); a device with one ping gives a trip
of zero length; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions.geo import EARTH_RADIUS_M, possible_position
from tidelane.runtime import BROADCAST_ROWS, salted_join, written

ITEMS = "device string, t0 bigint, t1 bigint, kind int, lat double, lon double, lat1 double, lon1 double, weight double, dist double, pings bigint"
#: kind of an item: a ping not settled yet, a settled stop, a settled piece of movement.
PING, STOP, MOVE = 0, 1, 2
RESULT = "device string, kind string, start_us bigint, end_us bigint, duration_s double, distance_m double, pings bigint, lat double, lon double"


def stops_and_trips(
    pings: DataFrame,
    device: str = "seg_id",
    ts: str = "ping_timestamp",
    lat: str = "lat",
    lon: str = "lon",
    radius_m: float = 250.0,
    min_stop_s: float = 3600.0,
    max_gap_s: float = 12 * 3600.0,
    max_faulty: int = 2,
    penalty: float = 0.5,
    hot_rows: int = 200_000,
) -> DataFrame:
    """RESULT rows: kind is stop or trip, times in epoch microseconds, lat/lon the centre of a stop (null for a trip)."""
    rules = (radius_m, min_stop_s * 1e6, max_gap_s * 1e6, max_faulty, penalty)
    points = pings.select(
        F.col(device).cast("string").alias("device"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")
    ).where(F.col("device").isNotNull() & F.col("t").isNotNull() & possible_position(F.col("lat"), F.col("lon")))
    busy, _ = written(points.groupBy("device").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows), "busy")
    devices = busy.count()
    if not devices:
        ordered = points.repartition("device").sortWithinPartitions("device", "t", "lat", "lon")
        return ordered.mapInArrow(lambda it: _tracks(it, rules, False), RESULT)
    few = devices <= BROADCAST_ROWS
    marks = F.percentile_approx("t", F.lit([k / 64 for k in range(1, 64)]), F.lit(1000))
    ranks = points.join(F.broadcast(busy) if few else busy, "device").groupBy("device", "n").agg(marks.alias("marks"))
    # about two slices for each hot_rows pings: between quantiles, and where 64 of them are too few, in equal parts between
    step = F.greatest(F.lit(1), F.floor(F.lit(32.0) * hot_rows / F.col("n"))).cast("int")
    cuts, _ = written(ranks.select("device", F.ceil(F.col("n") / (32.0 * hot_rows)).alias("parts"), F.array_distinct(F.filter("marks", lambda _, k: k % step == step - 1)).alias("cuts")), "cuts")
    sliced = points.join(F.broadcast(cuts), "device", "left") if few else salted_join(points, cuts, ["device"], F.col("t"), "left")
    place = F.size(F.filter("cuts", lambda c: c <= F.col("t")))
    low, high = F.get("cuts", place - 1), F.get("cuts", place)
    part = F.least(F.col("parts") - 1, F.floor((F.col("t") - low) * F.col("parts") / (high - low)))
    sliced = sliced.withColumn("slice", F.when(F.col("cuts").isNull(), F.lit(-1)).otherwise(place * F.col("parts") + F.coalesce(part, F.lit(0)))).drop("cuts", "parts")
    cold = sliced.where("slice < 0").drop("slice").repartition("device").sortWithinPartitions("device", "t", "lat", "lon").mapInArrow(lambda it: _tracks(it, rules, False), RESULT)
    items = sliced.where("slice >= 0").repartition("device", "slice").sortWithinPartitions("device", "slice", "t", "lat", "lon").mapInArrow(lambda it: _slices(it, rules), ITEMS)
    joined = items.repartition("device").sortWithinPartitions("device", "t0").mapInArrow(lambda it: _tracks(it, rules, True), RESULT)
    return cold.unionByName(joined)


def _groups(batches, keys: list[str]):
    """Columns (as numpy) of each run of equal keys in sorted Arrow batches."""
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        codes = [np.asarray(table[k].combine_chunks().dictionary_encode().indices) if pa.types.is_string(table.schema.field(k).type) else table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = table.slice(a, b - a)
            key = tuple(part[k][0].as_py() for k in keys)
            if key != last and kept:
                yield last, pa.concat_tables(kept)
                kept = []
            last = key
            kept.append(part)
    if kept:
        yield last, pa.concat_tables(kept)


def _to_batches(rows: list[tuple], names: list[str], types: list):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


RESULT_NAMES = ["device", "kind", "start_us", "end_us", "duration_s", "distance_m", "pings", "lat", "lon"]
RESULT_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
ITEM_NAMES = ["device", "t0", "t1", "kind", "lat", "lon", "lat1", "lon1", "weight", "dist", "pings"]
ITEM_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]


def _tracks(batches, rules, items: bool):
    rows: list[tuple] = []
    for (device,), table in _groups(batches, ["device"]):
        if items:
            cols = {k: table[k].to_numpy() for k in ITEM_NAMES[1:]}
            parts = _settle(cols, rules)
        else:
            t, la, lo = _once(table)
            parts = _atoms(t, la, lo, np.ones(len(t)), rules)
        rows += _itinerary(device, parts, rules)
        if len(rows) > 5000:
            yield from _to_batches(rows, RESULT_NAMES, RESULT_TYPES)
            rows = []
    yield from _to_batches(rows, RESULT_NAMES, RESULT_TYPES)


def _slices(batches, rules):
    for (device, _), table in _groups(batches, ["device", "slice"]):
        t, la, lo = _once(table)
        yield from _to_batches([(device, *r) for r in _slice_items(t, la, lo, rules)], ITEM_NAMES, ITEM_TYPES)


def _once(table: pa.Table):
    t, la, lo = (table[k].to_numpy() for k in ("t", "lat", "lon"))
    first = np.ones(len(t), bool)
    first[1:] = t[1:] != t[:-1]
    return t[first], la[first], lo[first]


def _plane(la, lo):
    """Metres on a plane around the first position; longitudes may cross the date line."""
    d = (lo - lo[0] + 180.0) % 360.0 - 180.0
    k = math.radians(1) * EARTH_RADIUS_M
    return d * k * np.cos(np.radians(np.clip(np.median(la), -89.9, 89.9))), (la - la[0]) * k


def _running_median(v, half: int = 2):
    if len(v) <= 2 * half:
        return np.full(len(v), np.median(v))
    padded = np.concatenate([v[half:0:-1], v, v[-2 : -half - 2 : -1]])
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)


def _atoms(t, la, lo, w, rules):
    """(t0, t1, kind, lat, lon, lat1, lon1, weight, distance, pings) in order of time; no movement spans a silence."""
    out = []
    breaks = [0, *(np.flatnonzero(np.diff(t) > rules[2]) + 1).tolist(), len(t)]
    for a, b in zip(breaks, breaks[1:]):
        if a == b:
            continue
        x, y = _plane(la[a:b], lo[a:b])
        stops = find_stops(t[a:b], x, y, w[a:b], rules)
        pos = 0
        for s, e, good in [*stops, (b - a, b - a, None)]:
            if s > pos:
                i, j = a + pos, a + s
                out.append((t[i], t[j - 1], MOVE, la[i], lo[i], la[j - 1], lo[j - 1], float(w[i:j].sum()), _length(x[pos:s], y[pos:s]), int(round(w[i:j].sum()))))
            if good is not None:
                g = a + good
                out.append((t[a + s], t[a + e], STOP, float(np.average(la[g], weights=w[g])), float(lo[g[0]] + np.average((lo[g] - lo[g[0]] + 180) % 360 - 180, weights=w[g])), la[a + e], lo[a + e], float(w[g].sum()), _length(x[good], y[good]), int(round(w[a + s : a + e + 1].sum()))))
                pos = e + 1
    return out


def _length(x, y) -> float:
    """Length of the filtered track: single jumps out and back don't count."""
    if len(x) < 2:
        return 0.0
    if len(x) > 4:
        mx, my = _running_median(x), _running_median(y)
        off = np.hypot(x - mx, y - my)
        step = np.median(np.hypot(np.diff(x), np.diff(y)))
        keep = off <= np.maximum(2000.0, 6 * step)
        x, y = x[keep], y[keep]
    return float(np.hypot(np.diff(x), np.diff(y)).sum())


def changepoints(signal: np.ndarray, penalty: float) -> list[int]:
    """Starts of segments of equal mean: a split stays where it lowers the squared error by more than the penalty.

    signal is (n, d); segments are split at the best place until no split pays.
    """
    n = len(signal)
    c = np.concatenate([np.zeros((1, signal.shape[1])), np.cumsum(signal, axis=0)])
    todo, starts = [(0, n)], [0]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        left = np.arange(1, b - a)[:, None]
        s, whole = c[a + 1 : b] - c[a], c[b] - c[a]
        gain = (s * s / left + (whole - s) ** 2 / (b - a - left)).sum(axis=1) - (whole * whole).sum() / (b - a)
        k = int(np.argmax(gain))
        if gain[k] > penalty:
            m = a + k + 1
            starts.append(m)
            todo += [(a, m), (m, b)]
    return sorted(starts)


def _linked(t, x, y, most: float, min_us: float, max_faulty: int) -> np.ndarray:
    """Pings of the stretches, min_us or longer, that links hold together: two pings at most `most` apart, up to max_faulty pings between.

    Two good pings of a stop in a row are such a link, so every stop lies in a stretch, whatever the segments around it.
    """
    n = len(t)
    open_ = np.zeros(n + 1, np.int64)
    for k in range(1, max_faulty + 2):
        i = np.flatnonzero(np.hypot(x[k:] - x[:-k], y[k:] - y[:-k]) <= most + 1e-6)
        open_[i] += 1
        open_[i + k] -= 1
    step = np.cumsum(open_)[: n - 1] > 0  # from each ping to the next
    flips = np.flatnonzero(np.diff(np.concatenate([[0], step.astype(np.int8), [0]])))
    out = np.zeros(n, bool)
    for a, b in zip(flips[::2], flips[1::2]):
        if t[b] - t[a] >= min_us:
            out[a : b + 1] = True
    return out


def find_stops(t, x, y, w, rules) -> list[tuple[int, int, np.ndarray]]:
    """(first, last, good pings) of every stop of one piece without silences."""
    radius, min_us, _, max_faulty, penalty = rules
    n = len(t)
    if n < 2 or t[-1] - t[0] < min_us:
        return []
    # filter, then displacement and speed between neighbours
    fx, fy = _running_median(x), _running_median(y)
    disp = np.minimum(np.hypot(np.diff(fx), np.diff(fy)), 1e5)
    floor_m = 0.4 * radius
    speed = disp / np.maximum(np.diff(t) / 1e6, 1.0)
    signal = np.column_stack([np.log10(np.maximum(disp, floor_m)), np.log10(np.maximum(speed, floor_m / 300.0))])
    starts = [*changepoints(signal, penalty), n - 1]
    # mobility label: within a stop no filtered step exceeds its diameter
    dwell = np.zeros(n, bool)
    for a, b in zip(starts, starts[1:]):
        if np.median(disp[a:b]) <= 2 * radius:
            dwell[max(0, a - 3) : b + 4] = True
    dwell |= _linked(t, x, y, 2 * radius, min_us, max_faulty)
    out, i = [], 0
    flips = np.flatnonzero(np.diff(np.concatenate([[0], dwell.astype(np.int8), [0]])))
    for a, b in zip(flips[::2], flips[1::2]):
        i = max(int(a), i)
        while i < b and t[b - 1] - t[i] >= min_us * 0.5:
            j = int(np.searchsorted(t, t[i] + min_us / 2, side="right"))
            run = _grow(x, y, w, i, min(j, n), radius, max_faulty, out[-1][1] + 1 if out else 0, n)
            if run is not None and t[run[1]] - t[run[0]] >= min_us:
                out.append(run)
                i = run[1] + 1
            else:
                step = int(np.searchsorted(t, t[i] + min_us / 4, side="right"))
                i = max(i + 1, min(step, n) if step > i else i + 1)
    return out


def _reach(ok, centre_i: int, max_faulty: int):
    """Run of good positions around one, bridging up to max_faulty bad ones in a row."""
    good = np.flatnonzero(ok)
    k = int(np.searchsorted(good, centre_i))
    wide = np.flatnonzero(np.diff(good) > max_faulty + 1)
    lo = wide[wide < k][-1] + 1 if (wide < k).any() else 0
    hi = wide[wide >= k][0] if (wide >= k).any() else len(good) - 1
    return good[lo : hi + 1]


def _grow(x, y, w, i, j, radius, max_faulty, low, high):
    """Largest run around the seed pings [i, j) that stays within the radius of its own centre."""
    seed_x, seed_y = np.median(x[i:j]), np.median(y[i:j])
    near = np.hypot(x[i:j] - seed_x, y[i:j] - seed_y)
    at = i + int(np.argmin(near))
    cx, cy = x[at], y[at]
    if near.min() <= radius:
        cx, cy = seed_x, seed_y
    before = None
    span = 64
    for _ in range(60):
        a, b = max(low, i - span), min(high, j + span)
        ok = np.hypot(x[a:b] - cx, y[a:b] - cy) <= radius
        if not ok[at - a]:
            return None
        good = a + _reach(ok, at - a, max_faulty)
        if (good[0] - a <= max_faulty + 1 and a > low) or (b - good[-1] <= max_faulty + 2 and b < high):
            span *= 4
            continue
        now = (int(good[0]), int(good[-1]), len(good))
        if now == before:
            break
        before = now
        cx, cy = np.average(x[good], weights=w[good]), np.average(y[good], weights=w[good])
    return int(good[0]), int(good[-1]), good


def _left_behind(t, x, y, at, step: int, rules) -> np.ndarray:
    """When, from each ping of `at` on (step 1) or back (-1), over max_faulty pings in a row have lain over a diameter from it.

    A stop that holds the ping has ended by then. Infinite where that takes longer than half of min_stop, or the arrays end.
    """
    radius, min_us, _, max_faulty, _ = rules
    n = len(t)
    out = np.full(len(at), step * np.inf)
    open_ = np.arange(len(at))
    run = np.zeros(len(at), np.int64)
    lag = 1
    while len(open_):
        p = at[open_]
        q = p + step * lag
        live = (q >= 0) & (q < n)
        live[live] = np.abs(t[q[live]] - t[p[live]]) < min_us / 2
        open_, p, q = open_[live], p[live], q[live]
        far = np.hypot(x[q] - x[p], y[q] - y[p]) > 2 * radius
        run[open_] = np.where(far, run[open_] + 1, 0)
        done = run[open_] > max_faulty
        out[open_[done]] = t[q[done]]
        open_ = open_[~done]
        lag += 1
    return out


def _cuts(t, x, y, a: int, b: int, rules) -> np.ndarray:
    """Whether no stop spans i -> i+1, for i from a to b.

    A stop across the cut has a good ping among the max_faulty + 1 on either side, within a diameter of each other, and
    lasts half of min_stop before or after the ping behind the cut. So on that side it takes a place not left within that time.
    """
    radius, min_us, max_gap, max_faulty, _ = rules
    n, reach = len(t), max_faulty + 1
    low, high = max(0, a - reach), min(n, b + reach + 1)
    near = np.arange(low, high)
    gone = {s: np.full(n, s * np.inf) for s in (1, -1)}
    for s in gone:
        gone[s][near] = _left_behind(t, x, y, near, s, rules)
    i = np.arange(a, b)
    before, after, apart = np.ones(b - a, bool), np.ones(b - a, bool), np.ones(b - a, bool)
    inside = (i - reach + 1 >= 0) & (i + reach < n)
    for p in range(reach):
        k = np.maximum(i - p, 0)
        before &= gone[-1][k] > t[i + 1] - min_us / 2
        for q in range(1, reach + 1):
            m = np.minimum(i + q, n - 1)
            if p == 0:
                after &= gone[1][m] < t[i + 1] + min_us / 2
            if q + p <= reach:
                apart &= np.hypot(x[k] - x[m], y[k] - y[m]) > 2 * radius
    return inside & (apart | (before & after)) | (np.diff(t)[a:b] > max_gap)


def _slice_items(t, la, lo, rules, block: int = 4096):
    """Items of one slice of a hot device: settled between the first and last cut that no stop can span, open pings beside them."""
    n = len(t)
    x, y = _plane(la, lo)
    first, last = n, n
    for a in range(0, n - 1, block):
        found = np.flatnonzero(_cuts(t, x, y, a, min(a + block, n - 1), rules))
        if len(found):
            first = a + int(found[0]) + 1
            break
    if first < n:
        for b in range(n - 1, 0, -block):
            found = np.flatnonzero(_cuts(t, x, y, max(0, b - block), b, rules))
            if len(found):
                last = max(0, b - block) + int(found[-1]) + 1
                break
    out = _open_items(t[:first], la[:first], lo[:first], rules)
    if last > first:
        out += _atoms(t[first:last], la[first:last], lo[first:last], np.ones(last - first), rules)
    return out + _open_items(t[last:], la[last:], lo[last:], rules)


def _open_items(t, la, lo, rules, keep: int = 50):
    """Pings as items; the middle of a long dwell becomes its hull points and one weighted centre."""
    n = len(t)
    whole = [np.arange(n)]
    extra = []
    if n > 8 * keep:
        x, y = _plane(la, lo)
        whole, pos = [], 0
        for s, e, good in find_stops(t, x, y, np.ones(n), (rules[0], 0.0, *rules[2:])):
            if len(good) <= 4 * keep:
                continue
            inner = good[keep:-keep]
            hull = np.unique(np.concatenate([inner[convex_hull(x[inner], y[inner])], inner[[0, -1]]]))
            rest = np.setdiff1d(inner, hull)
            whole += [np.arange(pos, good[keep]), hull]
            if len(rest):
                extra.append((t[rest[len(rest) // 2]], t[rest[len(rest) // 2]], PING, la[rest].mean(), lo[rest[0]] + ((lo[rest] - lo[rest[0]] + 180) % 360 - 180).mean(), 0.0, 0.0, float(len(rest)), 0.0, len(rest)))
            pos = int(good[-keep])
        whole.append(np.arange(pos, n))
    keep_i = np.unique(np.concatenate(whole)) if n else np.array([], int)
    return [(t[i], t[i], PING, la[i], lo[i], la[i], lo[i], 1.0, 0.0, 1) for i in keep_i] + extra


def convex_hull(x, y) -> np.ndarray:
    """Indices of the hull's corners, by the monotone chain."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order

    def half(points):
        h: list[int] = []
        for p in points:
            while len(h) > 1 and (x[h[-1]] - x[h[-2]]) * (y[p] - y[h[-2]]) <= (y[h[-1]] - y[h[-2]]) * (x[p] - x[h[-2]]):
                h.pop()
            h.append(int(p))
        return h

    return np.array(sorted({*half(order), *half(order[::-1])}))


def _settle(c, rules):
    """Items of all slices of one device: runs of open pings settled, the rest as it is."""
    out, n, i = [], len(c["t0"]), 0
    while i < n:
        if c["kind"][i] != PING:
            out.append(tuple(c[k][i] for k in ITEM_NAMES[1:]))
            i += 1
            continue
        j = i
        while j < n and c["kind"][j] == PING:
            j += 1
        out += _atoms(c["t0"][i:j], c["lat"][i:j], c["lon"][i:j], c["weight"][i:j], rules)
        i = j
    return out


def _itinerary(device: str, atoms: list[tuple], rules) -> list[tuple]:
    """Stops, and the trips between stops, silences and ends of the track."""
    rows: list[tuple] = []
    trip: list[tuple] = []
    before = None  # the stop just before the running trip

    def hop(a, b) -> float:
        k = math.radians(1) * EARTH_RADIUS_M
        dx = ((b[1] - a[1] + 180) % 360 - 180) * math.cos(math.radians(a[0]))
        return k * math.hypot(dx, b[0] - a[0])

    def close(after):
        nonlocal trip
        if trip:
            start = before[1] if before else trip[0][0]
            end = after[0] if after else trip[-1][1]
            chain = [*([before] if before else []), *trip]
            dist = sum(m[8] for m in trip) + sum(hop((a[5], a[6]), (b[3], b[4])) for a, b in zip(chain, chain[1:]))
            if after:
                dist += hop((trip[-1][5], trip[-1][6]), (after[3], after[4]))
            rows.append((device, "trip", int(start), int(end), (end - start) / 1e6, dist, int(sum(m[9] for m in trip)), None, None))
        trip = []

    for k, atom in enumerate(atoms):
        if k and atom[0] - atoms[k - 1][1] > rules[2]:
            close(None)
            before = None
        if atom[2] == STOP:
            close(atom)
            rows.append((device, "stop", int(atom[0]), int(atom[1]), (atom[1] - atom[0]) / 1e6, float(atom[8]), int(atom[9]), float(atom[3]), float(atom[4])))
            before = atom
        else:
            trip.append(atom)
    close(None)
    return rows
