import numpy as np
import pytest

from tidelane.functions.geo import haversine_np
from tidelane.operators import polygons as P
from tidelane.operators import proximity as X


def brute(p, radius):
    out = set()
    for i, (a, la, lo) in enumerate(p):
        for b, lb, mo in p[i + 1 :]:
            if haversine_np(la, lo, lb, mo) < radius:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("radius", [100.0, 5_000.0, 300_000.0])
def test_near_pairs_against_brute_force(spark, radius):
    rng = np.random.default_rng(1)
    step = radius / 111_000
    p = []
    for la, lo in ((0, 0), (60, 179.9999), (-60, -179.9999), (89.5, 10), (-89.99, 100), (45, 30)):
        for _ in range(25):
            lat = float(np.clip(la + rng.normal(0, step), -90, 90))
            lon = (lo + rng.normal(0, step) / max(0.01, np.cos(np.radians(lat))) + 180) % 360 - 180
            p.append((f"p{len(p):03d}", lat, float(lon)))
    df = spark.createDataFrame(p, "id string, lat double, lon double")
    got = [(r.id_a, r.id_b) for r in X.near_pairs(df, radius).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(p, radius)
    both = X.distance_join(df, df, radius, inclusive=False).where("id < r_id").select("id", "r_id").collect()
    assert sorted(map(tuple, both)) == sorted(got)


def test_positions(spark):
    rows = [("a", 1.0, 359.0, 1), ("a", 2.0, -1.0, 2), ("b", None, 1.0, 1), ("c", 91.0, 1.0, 1), (None, 1.0, 1.0, 1), ("d", 1.0, float("nan"), 1), ("e", 0.0, 360.0, None)]
    df = spark.createDataFrame(rows, "k string, y double, x double, v int").selectExpr("*", "'z' as id", "5 as lat")
    got = {r.id: (r.lat, r.lon) for r in X.positions(df, "k", "y", "x", "v").collect()}
    assert got == {"a": (2.0, -1.0), "e": (0.0, 0.0)}
    assert X.near_pairs(X.positions(df.limit(0), "k", "y", "x"), 10.0).count() == 0


SQUARE = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"


@pytest.mark.parametrize("text,parts", [
    (SQUARE, 1), ("  SRID=4326;MultiPolygon (((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))\n", 2), ("polygon((0 0 , 1 0 , 1 1 , 0 0))", 1),
    (None, 0), ("", 0), ("POLYGON EMPTY", 0), ("POLYGON((0 0, 1 0, 1 1", 0), ("POLYGON((0 0, 1 0, 1 1))", 0), ("POLYGON((0 0, 1 0, 0 0))", 0), ("POLYGON((0 0, 1 0, x 1, 0 0))", 0),
    ("POLYGON((0 95, 1 0, 1 1, 0 95))", 0), ("LINESTRING(0 0, 1 1)", 0), ("POLYGON((0 0, 1 0, 1 1, 0 0)", 0), ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6)))", 0),
])
def test_read_wkt(text, parts):
    assert len(P.read_wkt(text)) == parts


def test_areas_holding(spark):
    areas = [(1, SQUARE), (1, SQUARE), (2, "POLYGON((179 0, 182 0, 182 2, 179 2, 179 0))"), (3, "POLYGON((179 5, -179 5, -179 6, 179 6, 179 5))"), (4, None), (5, "POLYGON((0 0"), (None, SQUARE), (6, "MULTIPOLYGON(((0 0,8 0,8 8,0 8,0 0)),((2 2,9 2,9 9,2 9,2 2)))")]
    points = [("in", 2.0, 2.0), ("hole", 5.0, 5.0), ("out", 20.0, 20.0), ("east", 1.0, 181.5), ("west", 1.0, -178.5), ("line", 5.5, 180.0), ("turn", 2.0, 362.0), ("none", None, 1.0), (None, 1.0, 1.0)]
    a, p = spark.createDataFrame(areas, "area_id int, geometry string"), spark.createDataFrame(points, "id string, lat double, lon double")
    got = {(r.point, r.area) for r in P.areas_holding(p, a, "id", "lat", "lon", "area_id", "geometry").collect()}
    assert got == {("in", "1"), ("in", "6"), ("hole", "6"), ("east", "2"), ("west", "2"), ("line", "3")}
    assert P.areas_holding(p, a.limit(0), "id", "lat", "lon", "area_id", "geometry").count() == 0


def test_areas_against_brute_force(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 2 * np.pi, 40))
    r = rng.uniform(1, 3, 40)
    ring = [(10 + a * np.cos(b), -5 + a * np.sin(b)) for a, b in zip(r, t)]
    text = "POLYGON((" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in [*ring, ring[0]]) + "))"
    pts = [(f"{k}", float(rng.uniform(-9, -1)), float(rng.uniform(6, 14))) for k in range(3000)]
    inside = P.inside_rings(P.read_wkt(text)[0], np.array([p[2] for p in pts]), np.array([p[1] for p in pts]))
    got = {r.point for r in P.areas_holding(spark.createDataFrame(pts, "id string, lat double, lon double"), spark.createDataFrame([(1, text)], "a int, g string"), "id", "lat", "lon", "a", "g").collect()}
    assert got == {p[0] for p, k in zip(pts, inside) if k}
