"""Queries of the subpackage against their SQL on the smallest tables."""

import datetime as dt
import glob
import os
from collections import Counter

import duckdb
import pytest

from tidelane.llm import queries, survivors

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, D), c.execute(queries.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


EXTRAPOLATIONS = "ext_id bigint, ssvid string, scene_id string, source string, extrap_timestamp timestamp, loaded_at timestamp, " + ", ".join(f"{f} double" for f in queries._FIELDS)


def test_p4_found_estimates_nothing_and_holds_on_odd_rows(spark, tmp_path, monkeypatch):
    """No estimate can change a newest row, so none is made; ids are repeated across groups and reach the ends of bigint, times are equal or missing."""
    d = lambda k: dt.datetime(2020, 1, k) if k else None
    row = lambda i, v, at, *f, s="S", src="x": (i, v, s, src, d(1), d(at), *(f + (None,) * 6)[:6])
    low, high, nan = -(2**63), 2**63 - 1, float("nan")
    rows = [row(1, "a", 1, 1.0, 5.0), row(2, "a ", 3, 2.0, 102.3), row(1, "b", 2, 7.0, src=" X"), row(3, "b", 2, 7.0, 8.0, 360.0, s="s "), row(3, "c", 4, 1.0), row(low, "c", 4, 2.0, nan), row(high, "c", 4, None, 3.0), row(low, "c", 1, None, nan, 9.0)]
    rows += [row(5, "d", 0, 1.0, None, 2.0), row(4, "d", 0, 2.0), row(6, "e", 1, 1.0), row(7, None, 1, 1.0), row(8, None, 2, 1.0), row(9, " ", 2, 1.0), row(None, "e", 2, 1.0), row(10, "f", 1), row(11, "f", 2)]
    rows += [row(100 + k, "g", 1 + k % 3, 1.0) for k in range(300)] + [row(50, "g", 9, 2.0)]
    spark.createDataFrame(rows, EXTRAPOLATIONS).write.parquet(f"{tmp_path}/detect_foot_ext_doppler.parquet")
    monkeypatch.setattr(queries, "judged_values", lambda *a, **k: pytest.fail("p4_found estimates what can't matter"))
    c = duckdb.connect()
    c.execute(f"create view detect_foot_ext_doppler as select * from '{tmp_path}/detect_foot_ext_doppler.parquet/*.parquet'")
    want = c.execute(queries.SQL["p4_found"])
    names = [x[0] for x in want.description]
    got = Counter(tuple(r) for r in queries.p4_found(spark, str(tmp_path)).select(*names).collect())
    assert got == Counter(want.fetchall())
    assert got["a", "S", "X", "speed1", 1] == got["c", "S", "X", "delta_minutes1", low] == got["g", "S", "X", "delta_minutes1", 50] == 1


def test_p4_trusted_is_decided_by_the_estimates(spark, monkeypatch):
    rows = lambda: {tuple(r) for r in queries.p4_trusted(spark, D).collect()}
    judged = rows()
    monkeypatch.setattr(survivors, "_settled_here", lambda long, *_: long.select("w").distinct().selectExpr("w", "0.8D as se", "0.8D as sp"))
    assert judged and rows() != judged
