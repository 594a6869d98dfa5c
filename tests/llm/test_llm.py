"""Operators of the subpackage against brute force on small, dirty tables."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelane.llm import leakage, mixing, quantiles, spans, survivors, topn
from tidelane.llm.asof import nearest_in_time
from tidelane.llm.components import connected_components
from tidelane.llm.topn import top_n, winners_of

# ---- groups of pairs -----------------------------------------------------------------------------------------------


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in up}


def components(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("*", "1 as u", "2 as v", "3 as x", "4 as rep")
    return {tuple(r) for r in connected_components(df, "a", "b").collect()}


def test_components_chain_star_and_dirt(spark):
    pairs = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(200)] + [("hub", f"s{k}") for k in range(150)]
    pairs += [(None, "x"), ("y", None), ("z", "z"), ("hub", "s1"), ("s1", "hub"), ("", "e")]
    assert components(spark, pairs) == union_find(pairs)


def test_components_random_and_empty(spark):
    rng = random.Random(4)
    pairs = [(f"{rng.randrange(120)}", f"{rng.randrange(120)}") for _ in range(110)]
    assert components(spark, pairs) == union_find(pairs)
    assert components(spark, []) == set()


# ---- survivors -----------------------------------------------------------------------------------------------------

ROWS = "id bigint, g string, src string, at timestamp, f double, h double"


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'q' as gid", "'r' as field", "1 as n")
    claims, groups = survivors.claims_of(df, {"k": F.nullif(F.trim("g"), F.lit(""))}, "id", "at", F.coalesce("src", F.lit("-")), {"f": F.col("f"), "h": F.col("h")})
    values, quality = survivors.judged_values(claims, **kw)
    return values, groups, quality


def day(k):
    import datetime as dt

    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k)


def test_newest_filled_value(spark):
    rows = [(1, "a", "s", day(1), 1.0, None), (2, " a", "s", day(2), 2.0, None), (3, "a", "t", day(3), None, None), (4, "b", "s", day(1), 5.0, 5.0), (5, None, "s", day(9), 1.0, 1.0), (6, "", "s", day(9), 1.0, 1.0),
            (7, "c", "s", day(1), 1.0, 3.0), (8, "c", "s", day(1), 2.0, 4.0), (9, "d", "s", None, 1.0, None), (10, "d", None, day(1), 2.0, None)]
    values, groups, _ = judged(spark, rows, newest_bonus=100.0)
    got = {(r.k, r.field, r.row_id) for r in survivors.survivors(values).join(groups, "gid").collect()}
    assert got == {("a", "f", 2), ("c", "f", 7), ("c", "h", 7), ("d", "f", 10)}


def test_newest_wins_over_a_large_majority(spark):
    rows = [(k, "a", "good", day(1), 1.0, 1.0) for k in range(300)] + [(999, "a", "bad", day(2), 7.0, None)]
    values, _, _ = judged(spark, rows, newest_bonus=100.0)
    assert {(r.field, r.row_id) for r in survivors.survivors(values).collect()} == {("f", 999), ("h", 0)}


def test_trust_by_witness(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for g in range(60):  # two good witnesses agree on the truth, a bad one makes things up
        for src, right in (("good1", 0.95), ("good2", 0.95), ("bad", 0.1)):
            n += 1
            rows.append((n, f"g{g}", src, day(n % 5), float(g) if rng.random() < right else 1000.0 + n, None))
    values, groups, quality = judged(spark, rows)
    rate = {r.w: r.se for r in quality.collect()}
    assert rate["good1"] > 0.8 > rate["bad"]
    # the same by joins
    other, _, there = judged(spark, rows, few_rows=0)
    assert {r.w: round(r.se, 6) for r in there.collect()} == {w: round(x, 6) for w, x in rate.items()}
    key = lambda v: {(r.gid, r.value): round(r.p, 6) for r in v.collect()}
    assert key(other) == key(values)
    best = {r.k: float(r.value) for r in values.where("p >= 0.5").join(groups, "gid").collect()}
    assert sum(best.get(f"g{g}") == g for g in range(60)) >= 54


def test_survivors_empty(spark):
    values, _, quality = judged(spark, [])
    assert values.count() == 0 and quality.count() == 0


def test_planted_truth_within_groups(spark):
    """Sources of different quality speak within one group; a third of the claims are wrong. The model beats the newest and the most frequent value, and with equal witnesses it can't."""
    rng = random.Random(6)
    right = {"sure": 0.97, "fair": 0.75, "poor": 0.35, "worst": 0.2}
    rows, truth, n = [], {}, 0
    for g in range(300):
        truth[f"g{g}"] = float(g)
        for src, r in right.items():
            n += 1
            # wrong sources often agree with each other
            rows.append((n, f"g{g}", src, day(rng.randrange(9)), float(g) if rng.random() < r else 5000.0 + g, None))

    def share(rows):
        values, groups, _ = judged(spark, rows)
        got = {r.k: float(r.value) for r in survivors.survivors(values).join(groups, "gid").collect()}
        return sum(got[g] == v for g, v in truth.items()) / len(truth)

    by = defaultdict(list)
    for i, g, src, at, v, _ in rows:
        by[g].append((at, -i, v))
    newest = sum(max(v)[2] == truth[g] for g, v in by.items()) / len(truth)
    assert share(rows) > 0.93 and share(rows) > newest + 0.2
    assert share([(i, g, "one", at, v, h) for i, g, _, at, v, h in rows]) < 0.8


# ---- best of every group -------------------------------------------------------------------------------------------

SCORES = "g string, a string, b string, s double"


def best(rows, n):
    top = {}
    for g, a, b, s in rows:
        if None not in (g, a, b, s) and s == s:
            top[g, a, b] = max(s, top.get((g, a, b), -float("inf")))
    by = defaultdict(list)
    for (g, a, b), s in top.items():
        by[g].append((-s, a, b))
    return {(g, a, b, k + 1) for g, v in by.items() for k, (_, a, b) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("n", [1, 5])
def test_top_n(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", f"a{rng.randrange(30)}", f"b{rng.randrange(9)}", float(rng.randrange(20))) for _ in range(4000)]
    rows += [(None, "a", "b", 1.0), ("g1", None, "b", 1.0), ("g1", "a", "b", None), ("g1", "a", "b", float("nan")), ("inf", "a", "b", float("inf")), ("inf", "a", "c", float("-inf"))]
    df = spark.createDataFrame(rows, SCORES).selectExpr("g as grp", "a as i1", "b as i0", "s as sc", "1 as g", "2 as score", "3 as rank")
    got = {(r.grp, r.i1, r.i0, r["rank"]) for r in top_n(df, "grp", ["i1", "i0"], "sc", n, row_group_bytes=2048).collect()}
    assert got == best(rows, n)


def test_kept_layout_is_used_again(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(6)}", f"a{rng.randrange(40)}", "b", float(rng.randrange(90))) for _ in range(3000)]
    spark.createDataFrame(rows, SCORES).write.parquet(f"{tmp_path}/t")
    made = []
    cluster, topn.cluster = topn.cluster, lambda *a: (made.append(a), cluster(*a))
    try:
        for n in (3, 7):
            df = spark.read.parquet(f"{tmp_path}/t")
            assert {(r.g, r.a, r.b, r["rank"]) for r in top_n(df, "g", ["a", "b"], "s", n, row_group_bytes=2048, keep=True).collect()} == best(rows, n)
        assert len(made) == 1
        spark.createDataFrame([("g1", "z", "b", 999.0)], SCORES).write.mode("append").parquet(f"{tmp_path}/t")  # other files, another layout
        assert ("g1", "z", "b", 1) in {(r.g, r.a, r.b, r["rank"]) for r in top_n(spark.read.parquet(f"{tmp_path}/t"), "g", ["a", "b"], "s", 1, keep=True).collect()}
        assert len(made) == 2
    finally:
        topn.cluster = cluster


def test_row_groups_below_every_groups_nth_score_are_skipped(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    # row groups of two groups each, worse and worse, as later arrivals leave them
    parts = [pa.table({"g": ["x"] * 50 + ["y"] * 50, "i0": [f"{k}-{j}" for j in range(100)], "score": [100.0 - 10 * k - j % 50 / 10 for j in range(100)]}) for k in range(6)]
    with pq.ParquetWriter(f"{tmp_path}/f.parquet", parts[0].schema) as w:
        for p in parts:
            w.write_table(p)
    seen = list(topn._read(pq.ParquetFile(f"{tmp_path}/f.parquet"), ["i0"], 5, {}))
    assert [i for i, best in seen if best is None] == [1, 2, 3, 4, 5]
    assert sorted(seen[0][1]["score"].to_pylist()) == sorted(2 * [100.0 - j / 10 for j in range(5)])


def test_top_n_empty(spark):
    assert top_n(spark.createDataFrame([], SCORES), "g", ["a", "b"], "s", 3).count() == 0


def test_winners_of_a_table():
    import pyarrow as pa

    t = pa.table({"g": ["x", "x", "x", "y"], "i0": ["b", "a", "a", "c"], "score": [1.0, 1.0, 0.5, 2.0]})
    assert winners_of(t, ["i0"], 1).to_pylist() == [{"g": "x", "i0": "a", "score": 1.0}, {"g": "y", "i0": "c", "score": 2.0}]


# ---- nearest in time -----------------------------------------------------------------------------------------------


def nearest(left, right, tol):
    out = {}
    for i, e, t in left:
        c = [(abs(t - s), j) for j, f, s in right if e is not None and t is not None and None not in (j, f, s) and e == f and abs(t - s) <= tol]
        if c:
            out[i] = min(c)
    return {(i, j, g) for i, (g, j) in out.items()}


def test_nearest_in_time(spark):
    rng = random.Random(2)
    ent = lambda: "hot" if rng.random() < 0.4 else f"e{rng.randrange(8)}"
    left = [(f"l{k}", ent(), rng.randrange(200_000) * 100_000) for k in range(400)] + [("n1", None, 5), ("n2", "hot", None)]
    right = [(k, ent(), rng.randrange(200_000) * 100_000) for k in range(500)] + [(900, "hot", left[0][2]), (901, "hot", left[0][2]), (902, None, 1), (903, "hot", None)]
    right += [(950, left[3][1], left[3][2] + 1), (949, left[3][1], left[3][2] - 1)]
    l, r = spark.createDataFrame(left, "left_id string, entity string, t bigint"), spark.createDataFrame(right, "right_id bigint, entity string, t bigint")
    for tol in (600.0, 37.0):
        got = {tuple(x) for x in nearest_in_time(l, r, tol, start_s=5.0).collect()}
        assert got == nearest(left, right, round(tol * 1e6))
    assert nearest_in_time(l.limit(0), r, 600.0).count() == 0
    assert nearest_in_time(l, r.limit(0), 600.0).count() == 0


def test_nearest_before_1970(spark):
    l, r = spark.createDataFrame([("a", "e", -10_000_000)], "left_id string, entity string, t bigint"), spark.createDataFrame([(1, "e", -10_500_000), (2, "e", 610_000_000)], "right_id bigint, entity string, t bigint")
    assert [tuple(x) for x in nearest_in_time(l, r, 600.0).collect()] == [("a", 1, 500_000)]


# ---- percentiles ---------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6), max_size=400), min_size=1, max_size=6))
def test_summary_rank_error(parts):
    k = 32
    whole = quantiles.Summary(k)
    for p in parts:
        s = quantiles.Summary(k)
        s.add(np.array(p, float))
        whole.merge(quantiles.Summary.of(k, s.rows()))
    v = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert whole.n == len(v)
    if len(v):
        w = whole.weighted()[1]
        assert w.sum() == len(v)
        bound = quantiles.rank_error(len(v), k) * len(v) + 1
        for q in (0.1, 0.5, 0.9):
            x = whole.quantile(q)
            low, high = np.searchsorted(v, x, "left"), np.searchsorted(v, x, "right")
            r = q * (len(v) - 1)
            assert low - bound <= r <= high + bound


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    data = {"hot": rng.normal(0, 1, 20_000), "b": rng.exponential(3, 300), "one": np.array([4.0])}
    rows = [(g, float(x)) for g, v in data.items() for x in v] + [(None, 1.0), ("b", None), ("b", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7).selectExpr("g as k", "x as y", "1 as g0", "2 as v", "3 as piece")
    parts = quantiles.summaries(df, ["k"], "y", k=128, fan=2)
    got = {r.k: r for r in quantiles.percentiles(parts, ["k"], [0.0, 0.5, 0.9, 1.0], k=128).collect()}
    assert {g: r.n for g, r in got.items()} == {g: len(v) for g, v in data.items()}
    assert got["one"].q1 == 4.0 and got["one"].q0 == 4.0
    for g, v in data.items():
        for c, q in (("q1", 0.5), ("q2", 0.9)):
            rank = np.searchsorted(np.sort(v), got[g][c]) / len(v)
            assert abs(rank - q) <= quantiles.rank_error(len(v), 128) + 1.5 / len(v) or len(v) == 1
    days = parts.unionByName(parts)
    twice = {r.k: r.n for r in quantiles.percentiles(quantiles.merge_summaries(days, ["k"], k=128), ["k"], [0.5], k=128).collect()}
    assert twice == {g: 2 * len(v) for g, v in data.items()}
    assert quantiles.percentiles(quantiles.summaries(df.limit(0), ["k"], "y"), ["k"], [0.5]).count() == 0


# ---- leaks ---------------------------------------------------------------------------------------------------------

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "na re ti so pu".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def leaked(d, i, least=25):
    """All alignments of two texts, word by word."""
    kept = {}
    a, b = leakage.word_codes(d, kept), leakage.word_codes(i, kept)
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        bad = np.concatenate([[0], np.cumsum(a[lo:hi] != b[lo - shift : hi - shift])])
        for x in range(hi - lo - least + 1):
            if ((bad[x + least :] - bad[x]) * 10 <= np.arange(least, hi - lo - x + 1)).any():
                return True
    return False


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, text(rng, rng.randrange(40, 90))) for k in range(12)] + [(50, ""), (51, None), (None, text(rng, 40)), (52, "few words only")]
    docs = []
    for k in range(120):
        words = text(rng, rng.randrange(20, 120)).split()
        if k % 3 == 0:  # a passage of an item, some words exchanged, other case and punctuation
            src = items[k % 12][1].split()
            n = rng.randrange(15, 40)
            at = rng.randrange(0, max(1, len(src) - n))
            cut = src[at : at + n]
            for j in range(rng.choice([0, 1, 2, 5])):
                cut[rng.randrange(len(cut))] = "zz"
            p = rng.randrange(len(words))
            words[p:p] = [w.upper() + ("," if rng.random() < 0.3 else "") for w in cut] + ["--"]
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "!!! ---"), (None, items[0][1]), (903, items[3][1]), (904, items[3][1]), (905, text(rng, 15_000) + " " + items[5][1])]
    d = spark.createDataFrame(docs, "doc bigint, text string").selectExpr("*", "1 as item", "2 as words")
    i = spark.createDataFrame(items, "item bigint, text string").selectExpr("*", "1 as doc")
    got = {(r.doc, r.item) for r in leakage.leaks(d.select("doc", "text"), i.select("item", "text"), rank=32).collect()}
    want = {(a, b) for a, t in docs for b, s in items if a is not None and b is not None and t and s and (a < 905 or b == 5) and leaked(t if a < 905 else t[-4000:], s)}
    assert got == want and (903, 3) in got and (905, 5) in got
    assert leakage.leaks(d.select("doc", "text").limit(0), i.select("item", "text")).count() == 0
    assert leakage.leaks(d.select("doc", "text"), i.select("item", "text").limit(0)).count() == 0


def test_shortest_leaks_in_foreign_texts(spark):
    """25 words, up to two of them exchanged, anywhere in a text that repeats words of its own."""
    rng = random.Random(11)
    items = [(k, text(rng, 60)) for k in range(40)]
    docs = []
    for k, (_, s) in enumerate(items):
        for exchanged in (0, 1, 2):
            at, p = rng.randrange(36), rng.randrange(200)
            cut = s.split()[at : at + 25]
            for j in rng.sample(range(25), exchanged):
                cut[j] = f"other{rng.randrange(10**6)}"
            words = [f"foreign{k}{'ab'[j % 2]}" for j in range(200)]
            docs.append((3 * k + exchanged, " ".join(words[:p] + cut + words[p:])))
    got = leakage.leaks(spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string")).collect()
    assert {(r.doc, r.item) for r in got} == {(k, k // 3) for k in range(120)}


def test_candidates_come_from_the_latent_space(spark, monkeypatch):
    """Rows come through the singular directions: with directions that tell nothing, or a cosine that nothing reaches, none do."""
    rng = random.Random(17)
    items = [(k, text(rng, 60)) for k in range(10)]
    docs = spark.createDataFrame([(k, text(rng, 40) + " " + s + " " + text(rng, 40)) for k, s in items], "doc bigint, text string")
    found = lambda **kw: {(r.doc, r.item) for r in leakage.leaks(docs, spark.createDataFrame(items, "item bigint, text string"), **kw).collect()}
    assert found() == {(k, k) for k in range(10)}
    assert found(least_cosine=1.1) == set()
    monkeypatch.setattr(leakage, "singular_directions", lambda docs, idf, rank, fit: (np.zeros(rank), np.zeros((leakage.FEATURES, rank))))
    assert found() == set()


def test_singular_directions(spark):
    """Against the exact decomposition of the same matrix."""
    rng = random.Random(19)
    topics = [[text(rng, 1) for _ in range(12)] for _ in range(6)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(topics[k % 6]) for _ in range(70))) for k in range(120)], "doc bigint, text string")
    words = leakage.coded(docs)
    idf = leakage.inverse_frequency(words)
    values, directions = leakage.singular_directions(words, idf, 8, 32)
    rows = []
    for r in words.collect():
        w = np.frombuffer(r.words, np.uint32) % leakage.FEATURES
        first = [*range(0, len(w) - 32 + 1, 32)]
        first += [len(w) - 32] if first[-1] != len(w) - 32 else []
        bounds = [*first, len(w)]
        rows += [np.bincount(w[a:b], idf[w[a:b]], leakage.FEATURES) for a, b in zip(bounds, bounds[1:])]  # a word counts in the passage that starts last
    a = np.array(rows)
    exact = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:6], exact[1][:6], rtol=0.02)
    assert np.linalg.norm(a @ directions) >= 0.99 * np.sqrt((exact[1][:8] ** 2).sum())
    assert np.allclose(directions.T @ directions, np.eye(8), atol=1e-8)


def test_paraphrase_checks(spark):
    rng = random.Random(3)
    item = text(rng, 32).split()
    moved = item[:10] + ["so", "then"] + item[10:20] + ["as"] + item[21:]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, None), (3, ""), *[(k, text(rng, 60)) for k in range(4, 40)]], "doc bigint, text string")
    got = leakage.paraphrases(docs, spark.createDataFrame([(9, " ".join(item)), (10, ""), (11, None)], "item bigint, text string"), rank=16).collect()
    assert [(r.doc, r.item) for r in got] == [(1, 9)]


def test_paraphrases_in_foreign_texts(spark):
    """A passage from any place of an item, up to a quarter of its words exchanged, in texts of common words; and a text of 20 000 words that merely holds all of them somewhere."""
    rng = random.Random(13)
    common = [text(rng, 1) for _ in range(1500)]
    zipf = lambda n: rng.choices(common, [1 / (k + 8) for k in range(1500)], k=n)
    items = [(k, " ".join(zipf(80))) for k in range(40)]
    docs, planted = [], set()
    for k, (_, s) in enumerate(items):
        for exchanged in (0, 3, 8):
            at, p = rng.randrange(49), rng.randrange(150)
            cut = s.split()[at : at + 32]
            for j in rng.sample(range(32), exchanged):
                cut[j] = rng.choice(common)
            words = zipf(150)
            planted.add((len(docs), k))
            docs.append((len(docs), " ".join(words[:p] + cut + words[p:])))
    docs.append((999, " ".join(zipf(20_000))))
    got = leakage.paraphrases(spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string"), least_answer=0.0).collect()
    found = {(r.doc, r.item) for r in got}
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found & planted) >= 0.9 * len(found)
    assert 999 not in {d for d, _ in found}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_common_subsequence(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert leakage.common_subsequence(np.array(a, np.int64), np.array(b, np.int64)) == t[-1, -1]


# ---- mixing --------------------------------------------------------------------------------------------------------


def counts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, tokens bigint")


def test_mixture_meets_its_targets(spark):
    rng = random.Random(0)
    rows = [(k, "big" if k % 3 else "mid", rng.randrange(50, 500)) for k in range(3000)] + [(10_000 + k, "small", 100) for k in range(30)] + [(20_000, None, 5000), (20_001, "big", 0)]
    targets = spark.createDataFrame([("Big ", 0.3, 2), ("MID", 0.4, 3), ("small", 0.02, 4), ("absent", 0.0, 1), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    copies, plan = mixing.mixture(counts(spark, rows), targets, weight=F.log1p("tokens"))
    copies = copies.collect()
    assert len({c.id for c in copies}) == len(copies) and min(c.copies for c in copies) >= 1
    total = sum(r[2] for r in rows)
    got = defaultdict(int)
    for c in copies:
        got[c.source] += c.tokens * c.copies
    assert abs(got["big"] / total - 0.3) < 0.005 and abs(got["mid"] / total - 0.4) < 0.01
    reach = {r.source: r.reachable for r in plan.collect()}
    assert reach == {"big": True, "mid": True, "small": 30 * 100 * 4 >= 0.02 * total, "absent": True, "gone": False}
    assert all(c.copies == 4 for c in copies if c.source == "small") == (not reach["small"]) and max(c.copies for c in copies if c.source == "mid") <= 3
    drawn = {r.source: r.short for r in mixing.shares(*mixing.mixture(counts(spark, rows), targets)).collect()}
    assert {s for s, short in drawn.items() if short} == {"gone", *([] if reach["small"] else ["small"])}
    # without the draws the report is another
    assert {r.source for r in mixing.shares(mixing.mixture(counts(spark, rows), targets)[0].limit(0), plan).where("short").collect()} != {s for s, short in drawn.items() if short} or reach["small"]
    assert set(drawn) == {"Big ", "MID", "small", "absent", "gone"}


def test_sample_has_a_fixed_size(spark):
    rows = [(k, "a", 10) for k in range(1000)]
    for seed in range(3):
        copies, _ = mixing.mixture(counts(spark, rows), spark.createDataFrame([("a", 0.123, 1)], "source string, target_share double, max_repeats int"), seed=seed)
        assert copies.count() == 123


def test_multiples_end_only_when_they_meet_the_target(spark):
    """Weights so different that the cap is hit by one size of document after the other."""
    rows = [(k, "a", 2 ** (k % 60)) for k in range(60)]
    total = sum(r[2] for r in rows)
    targets = spark.createDataFrame([("a", 1.9, 2)], "source string, target_share double, max_repeats int")
    plan = mixing._multiples(mixing.allocation(counts(spark, rows), targets), counts(spark, rows), F.col("tokens").cast("double")).collect()[0]
    assert abs(sum(min(plan.c * t, 2) * t for _, _, t in rows) / total - 1.9) < 1e-6


def test_many_targets(spark, monkeypatch):
    monkeypatch.setattr("tidelane.runtime.BROADCAST_ROWS", 3)
    rows = [(k, f"s{k % 12}", 10 + k % 7) for k in range(600)]
    targets = spark.createDataFrame([(f"s{k}", 0.02 * k, 3) for k in range(12)], "source string, target_share double, max_repeats int")
    total = sum(r[2] for r in rows)
    for r in mixing.shares(*mixing.mixture(counts(spark, rows), targets)).collect():
        assert abs(r.tokens / total - r.target_share) < 0.01 or r.short


@pytest.mark.parametrize("glue", [" ", "-", "", "\n"])
def test_long_texts_count_as_they_would_in_one(glue):
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    rng = random.Random(1)
    t = glue.join(rng.choice(["fish", "3", "..", "Ünï", "it's", "a  b", "x\t"]) for _ in range(3000))
    encoding = mixing._encoding(vocabulary)
    parts = list(mixing._stretches(t, 100))
    assert "".join(parts) == t and sum(len(encoding.encode_ordinary(p)) for p in parts) == len(encoding.encode_ordinary(t))


def test_mixture_of_nothing(spark):
    copies, plan = mixing.mixture(counts(spark, []), spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int"))
    assert copies.count() == 0 and plan.count() == 1


def test_token_counts(spark):
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, " A ", "hello world"), (2, None, None), (3, "b", ""), (4, "b", "word " * 60_000)], "k bigint, s string, t string").selectExpr("*", "1 as id", "2 as tokens")
    got = {r.id: (r.source, r.tokens) for r in mixing.token_counts(df, "k", "s", "t", vocabulary).collect()}
    assert got[1] == ("a", 2) and got[2] == (None, 0) and got[3] == ("b", 0) and abs(got[4][1] - 60_000) <= 2


# ---- shared spans --------------------------------------------------------------------------------------------------


def shared(docs, n):
    where = defaultdict(set)
    for i, t in docs:
        for k in range(len(t) - n + 1):
            where[t[k : k + n]].add(i)
    out = set()
    for i, t in docs:
        run = None
        for k in range(len(t) - n + 1):
            if len(where[t[k : k + n]]) > 1:
                if run and k <= run[1]:
                    run[1] = k + n
                else:
                    if run:
                        out.add((i, *run))
                    run = [k, k + n]
        if run:
            out.add((i, *run))
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_shared_spans(spark, seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefg hij\U0001F600é") for _ in range(n))
    boiler = letters(90)
    docs = []
    for k in range(60):
        t = letters(rng.randrange(0, 200))
        if k % 4 == 0:
            p = rng.randrange(len(t) + 1)
            t = t[:p] + boiler[rng.randrange(20) : 70 + rng.randrange(20)] + t[p:]
        docs.append((k, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "-" * 300), (103, "x" + "-" * 150 + "y"), (104, "ab" * 100), (105, "ab" * 60 + "!"), (106, boiler + boiler), (107, "z" * 39), (108, "q" * 40), (109, "q" * 40)]
    n = 40
    df = spark.createDataFrame([*docs, (200, None), (201, ""), (None, docs[3][1])], "k bigint, body string").selectExpr("k as doc_id", "body as text", "1 as doc", "2 as name", "3 as shared")
    got = {tuple(r)[:3] for r in spans.shared_spans(df, "doc_id", "text", n).collect()}
    assert got == shared(docs, n)
    assert spans.shared_spans(df.limit(0), "doc_id", "text", n).count() == 0


def test_spans_begin_and_end_within_the_text(spark):
    """Texts that begin and end with what they share, next to each other in one chunk."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    common = [letters(rng.randrange(60, 200)) for _ in range(12)]
    docs = [(k, rng.choice(common) + letters(rng.choice([0, 1, 30, 90])) + rng.choice(common)) for k in range(80)]
    lone = letters(300)
    docs += [(100, lone), (101, lone), (102, lone[:80] + letters(60)), (103, "!" + lone[200:] + "?")]  # a text that only copies hold, and parts of it
    for k in range(20):  # a piece that stands whole in two texts, and a part of it once more in one of them
        piece = letters(200)
        docs += [(200 + 2 * k, letters(9) + piece + letters(9) + piece[:60] + letters(5)), (201 + 2 * k, letters(30) + piece + letters(7))]
    got = {tuple(r)[:3] for r in spans.shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 50).collect()}
    assert got == shared(docs, 50)


def test_equal_windows_get_equal_symbols():
    rng = random.Random(5)
    core = "".join(rng.choice("abcd ") for _ in range(400))
    seen = []
    for before, after in (("xyz", "q"), ("", "pppp"), ("aaaaaaa", "")):
        t = before + core + after
        code, wall, starts = spans._joined([t])
        name, start, low, high = spans.parse(code, wall)
        off = starts[0] + len(before)
        inside = (low >= off) & (high <= off + len(core))
        assert inside.sum() > 5
        seen.append({(int(s - off), int(x)) for s, x in zip(start[inside], name[inside])})
    for a, b in combinations(seen, 2):  # a symbol whose dependence lies in both copies is the same in both
        assert len(a & b) > 5
        assert {s for s in a if 60 < s[0] < 340} == {s for s in b if 60 < s[0] < 340}
