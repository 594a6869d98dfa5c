"""Queries against their SQL on the smallest tables, and what the entry point promises."""

import glob
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECKED = [
    "a3_density_by_country", "a19_zone_area", "j6_repeated_objects", "d17_hub_table", "d2_score_ais", "d5_mutual_best", "d8_score_multiplied", "d1_vessels_in_scenes", "j16_rolling_24_days", "d25_gap_interpolation",
    "w13_rolling_statistics", "d33_dbscan_components", "d35_cluster_lifetimes", "d36_relabel", "ar6_ambiguity", "j8_radius_density", "d50_calibrated", "d15_rasterize_footprints", "j2_left_lookup_chain", "f8_dates", "k1_overwrite_and_delete_days", "st2_incremental_days", "p3_near",
]


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x).replace("+00:00", "").replace(" 00:00:00", "")
    return Counter(tuple(text(x) if str(x) not in ("NaT", "<NA>") else "" for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, D).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_subpackage():
    code = "import sys, pkgutil, importlib; sys.modules['tidelane.llm'] = None; import tidelane, __spark_entry__ as e; [importlib.import_module(m.name) for m in pkgutil.walk_packages(tidelane.__path__, 'tidelane.') if not m.name.startswith('tidelane.llm')]; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


@pytest.mark.skipif(not os.path.isdir(f"{REPO}/tidelane/llm"), reason="the subpackage is absent")
def test_a_missing_library_hides_no_queries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    r = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert r.returncode and "xxhash" in r.stderr
