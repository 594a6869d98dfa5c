import io
import json
import struct
import zipfile

import numpy as np
import pyarrow as pa

from tidelane.sources import files, sinks

NAME = "S1A_IW_GRDH_1SDV_20200102T030405_20200102T030430_000001_000001_ABCD"


def test_geojson(spark, tmp_path):
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, -2.25]}, "properties": {}}
    (tmp_path / f"{NAME}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point]}))
    (tmp_path / "broken.json").write_text('{"type": ')
    r = files.geojson_points(spark, str(tmp_path)).collect()
    assert [(x.lon, x.lat, x.detect_id, x.start_time.hour) for x in r] == [(1.5, -2.25, f"{NAME};1.500000000;-2.2500000", 3)]
    assert {x.ok for x in files.readable_json(spark, str(tmp_path)).collect()} == {True, False}


def test_footprints(spark, tmp_path):
    ring = [[0, 0], [0.5, 0.001], [1, 0], [1, 1], [0, 1], [0, 0]]
    square = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {}}
    (tmp_path / "a.json").write_text(json.dumps({"features": [square, square]}))
    (tmp_path / "b.json").write_text("nothing")
    r = files.geojson_footprints(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].footprint_wkt.count("(0.000000 0.000000") == 2 and "0.500000 0.001000" in r[0].footprint_wkt and "0.500000" not in r[0].footprint_wkt_1


def test_archives_and_arrays(spark, tmp_path):
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/a.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n3,4\n")
        z.writestr("y.csv", "a,b\n5,6\n")
    assert sorted(map(tuple, files.zipped_csv(spark, str(tmp_path / "z"), "a bigint, b bigint").collect())) == [(1, 2), (3, 4), (5, 6)]
    (tmp_path / "n").mkdir()
    np.save(tmp_path / "n/g.npy", np.array([[1.0, -1.0], [np.nan, 2.0]]))
    assert sorted((r.lat, r.lon, r.v) for r in files.grid_files(spark, str(tmp_path / "n")).collect()) == [(-45.0, 90.0, 2.0), (45.0, -90.0, 1.0)]
    (tmp_path / "t").mkdir()
    np.save(tmp_path / "t/t.npy", np.zeros((3, 2, 2)))
    assert files.tile_arrays(spark, str(tmp_path / "t"), (2, 2)).count() == 3
    (tmp_path / "f").mkdir()
    sink = io.BytesIO()
    with pa.ipc.new_file(sink, pa.schema([("a", pa.int64())])) as f:
        f.write_batch(pa.record_batch([pa.array([1, 2])], names=["a"]))
    (tmp_path / "f/x.feather").write_bytes(sink.getvalue())
    assert [r.a for r in files.feather(spark, str(tmp_path / "f"), "a bigint").collect()] == [1, 2]


def test_every_second(spark):
    df = spark.sql("select 's' as sat, timestamp'2020-01-01 00:00:00' as t, 0d as lat, 0d as lon union all select 's', timestamp'2020-01-01 00:00:04', 4d, 8d")
    assert [(r.lat, r.lon) for r in files.every_second(df).orderBy("t").collect()] == [(0, 0), (1, 2), (2, 4), (3, 6), (4, 8)]


def test_days(spark, tmp_path):
    df = spark.sql("select date'2020-01-01' as date, 1 as v union all select date'2020-01-02', 2")
    path = str(tmp_path / "d")
    sinks.overwrite_days(df, path)
    sinks.overwrite_days(df.where("v = 2").selectExpr("date", "9 as v"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]
    sinks.delete_day(spark, path, "2020-01-01")
    assert [str(r.date) for r in sinks.missing_days(df, spark.read.parquet(path)).collect()] == ["2020-01-01"]


def test_shape_lines(spark, tmp_path):
    xy = [(0.0, 0.0), (1.0, 2.0), (5.0, 5.0), (6.0, 6.0), (7.0, 5.0)]
    body = struct.pack("<i4d2i2i", 3, 0, 0, 7, 6, 2, 5, 0, 2) + b"".join(struct.pack("<2d", *p) for p in xy)
    empty = struct.pack("<i", 0)
    records = b"".join(struct.pack(">ii", k, len(b) // 2) + b for k, b in ((1, body), (2, empty), (3, body)))
    (tmp_path / "a.shp").write_bytes(bytes(100) + records)
    got = files.shape_lines(spark, str(tmp_path))
    assert sorted((r.record, r.part, r.k, r.lon, r.lat) for r in got.collect()) == [(n, *x) for n in (1, 3) for x in [(0, 0, 0.0, 0.0), (0, 1, 1.0, 2.0), (1, 0, 5.0, 5.0), (1, 1, 6.0, 6.0), (1, 2, 7.0, 5.0)]]
    shore = spark.createDataFrame([(5.0, 5.001)], "lat double, lon double")
    assert {r.part for r in files.near_areas(got, shore, 11_000.0, ["record", "part"]).collect()} == {1}


def test_table_comment(spark):
    spark.range(1).write.mode("overwrite").saveAsTable("described")
    sinks.describe(spark, "described", "it's from \\ here")
    row = [r for r in spark.sql("describe extended described").collect() if r.col_name == "Comment"]
    assert row[0].data_type == "it's from \\ here"
    spark.sql("drop table described")
