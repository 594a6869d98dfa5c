"""One surviving record for each group of duplicates: a latent two-sided quality model of who is right.

Each row that fills a field claims its value and denies the group's other values of that field. A witness (here: a
source's rows of one lateness class) has a sensitivity, the chance that it claims a true value, and a specificity, the
chance that it doesn't claim a false one. Expectation-maximisation infers both for every witness together with the
probability that each value is true; fields may keep every value judged true.

Only the pattern of a value matters (rows and claims by witness), so values are counted by pattern once, and the
iterations, which end when no rate moves any more, run over the patterns: on the driver while those are few, else as joins of the patterns'
witnesses with the rates. `newest_bonus` adds log-odds to the value of the newest row that fills a field. The
witnesses' evidence is clipped to +-EVIDENCE, so a bonus above twice that makes recency decide, while the other values
still rank by trust. Where only the newest row is asked for, no estimate can matter: `newest_filled` gives it without.

All steps of the model are aggregations by (group, field, value), which combine before the shuffle, and one join that
salts hot groups; `newest_filled` is one aggregation by group, likewise combined before. A group with a third of all
rows is never gathered.

Defined results: rows with a null key are in no group; a null field isn't filled; a field that no row fills is absent;
ties in time go to the smaller row id; rows without a time count as oldest; groups of one row give no result; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.runtime import HOT_ROWS, HOT_SHARE, discard, hot_keys, salted_join, small, written

EVIDENCE = 30.0
#: Up to so many pattern-witness rows the iterations run on the driver; the result is the same.
FEW_ROWS = 100_000
#: A witness's rates at the start, and their bounds.
START, LEAST, MOST = 0.8, 0.01, 0.99
#: An iteration that hasn't settled by then raises an error.
MOST_ROUNDS = 5_000


def newest_filled(df: DataFrame, keys: dict[str, Column], row_id: str, at: str, fields: dict[str, Column]) -> DataFrame:
    """(keys, field, row_id): for each group with two or more rows and each field, the newest row that fills it."""
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.col(row_id).cast("bigint").alias("row_id"), F.col(at).alias("at"), *[c.alias(f"f_{k}") for k, c in fields.items()]).dropna(subset=[*keys, "row_id"])
    order = F.struct("at", F.bitwise_not("row_id").alias("back"))  # unlike a minus sign, defined for every bigint
    newest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col(f"f_{k}").isNotNull(), order)).alias(f"f_{k}") for k in fields]).where("n > 1")
    best = F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.bitwise_not(F.col(f"f_{k}.back")).alias("row_id")) for k in fields]))
    return newest.select(*keys, best).where("row_id is not null")


def claims_of(df: DataFrame, keys: dict[str, Column], row_id: str, at: str, witness: Column, fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(claims, groups) of the groups with two or more rows. claims: gid, field, value, w, row_id, at; groups: gid and the keys.

    row_id is unique, so its smallest in a group serves as the group's short id.
    """
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.col(row_id).cast("bigint").alias("row_id"), F.col(at).alias("at"), witness.alias("w"), *[c.cast("string").alias(f"f_{k}") for k, c in fields.items()]).dropna(subset=[*keys, "row_id"])
    counted, _ = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("gid")).where("n > 1"), "groups")
    groups = counted.drop("n")
    floor = max(HOT_ROWS, int(HOT_SHARE * (counted.agg(F.sum("n")).first()[0] or 0)))
    few = counted.where(F.col("n") > floor).select(*keys, F.ceil(F.col("n") / floor).cast("int").alias("__salts"))
    members = salted_join(rows, groups, list(keys), F.col("row_id"), hot=None if few.isEmpty() else few).drop(*keys)
    filled = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"f_{k}").alias("value")) for k in fields])).alias("c")
    claims = members.select("gid", "row_id", "at", "w", filled).select("gid", "row_id", "at", "w", "c.*").where("value is not null")
    return claims, groups


def judged_values(claims: DataFrame, newest_bonus: float = 0.0, prior: float = 0.5, tolerance: float = 1e-4, few_rows: int = FEW_ROWS) -> tuple[DataFrame, DataFrame]:
    """(values, quality). values: gid, field, value, row_id, at (of the newest row that claims it), p; quality: w, se, sp, the sensitivity and specificity of each witness."""
    spark = claims.sparkSession
    newest = F.max(F.struct("at", (-F.col("row_id")).alias("back"))).alias("best")
    counted, counted_path = written(claims.groupBy("gid", "field", "value", "w").agg(F.count(F.lit(1)).alias("c"), newest), "counted")
    facts = counted.groupBy("gid", "field", "value").agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("claimed"), F.max("best").alias("best"))
    cover = counted.groupBy("gid", "field", "w").agg(F.sum("c").alias("n"), F.max("best").alias("best"))
    cover = cover.groupBy("gid", "field").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("rows"), F.max("best").alias("top"))
    seen = F.transform("rows", lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), F.coalesce(F.element_at(F.col("claimed"), x["w"]), F.lit(0)).cast("bigint").alias("c")))
    joined = salted_join(facts, cover, ["gid", "field"], F.col("value"), hot=hot_keys(counted, ["gid", "field"]))
    values, values_path = written(joined.select("gid", "field", "value", "best", seen.alias("seen"), (F.col("best") == F.col("top")).alias("newest")), "values")
    patterns, patterns_path = written(values.groupBy("seen", "newest").count().withColumn("pid", F.monotonically_increasing_id()), "patterns")
    long, long_path = written(patterns.select("pid", "count", "newest", F.inline("seen")), "long")
    base = math.log(prior / (1 - prior))
    quality = (_settled_here if long.count() <= few_rows else _settled_there)(long, base, newest_bonus, tolerance)
    judged = patterns.join(_probabilities(long, quality, base, newest_bonus), "pid")
    if small(patterns):
        out = values.join(F.broadcast(judged.select("seen", "newest", "p")), ["seen", "newest"])
    else:
        floor = max(HOT_ROWS, int(HOT_SHARE * values.count()))
        few = patterns.where(F.col("count") > floor).select("seen", "newest", F.ceil(F.col("count") / floor).cast("int").alias("__salts"))
        out = salted_join(values, judged.select("seen", "newest", "p"), ["seen", "newest"], F.col("gid"), hot=None if few.isEmpty() else few)
    result, _ = written(out.select("gid", "field", "value", (-F.col("best.back")).alias("row_id"), F.col("best.at").alias("at"), "p"), "judged")
    discard(spark, counted_path, values_path, patterns_path, long_path)
    return result, quality


QUALITY = "w string, se double, sp double"


def _settled_here(long: DataFrame, base: float, newest_bonus: float, tolerance: float) -> DataFrame:
    """The rates of all witnesses, iterated on the driver over a bounded number of rows."""
    spark = long.sparkSession
    t = long.toPandas()
    if not len(t):
        return spark.createDataFrame([], QUALITY)
    names, w = np.unique(t["w"].to_numpy(str), return_inverse=True)
    pattern, first, pid = np.unique(t["pid"].to_numpy(), return_index=True, return_inverse=True)
    n, c = t["n"].to_numpy(float), t["c"].to_numpy(float)
    count = t["count"].to_numpy(float)
    bonus = np.where(t["newest"].to_numpy(bool)[first], newest_bonus, 0.0)
    se = sp = np.full(len(names), START)
    for _ in range(MOST_ROUNDS):
        said, denied = np.log(se / (1 - sp)), np.log((1 - se) / sp)
        weight = np.bincount(pid, c * said[w] + (n - c) * denied[w], len(pattern))
        p = (1 / (1 + np.exp(-(base + np.clip(weight, -EVIDENCE, EVIDENCE) + bonus))))[pid]
        of = lambda v: np.bincount(w, count * v, len(names))  # noqa: B023, E731
        new_se, new_sp = np.clip((of(p * c) + 4) / (of(p * n) + 5), LEAST, MOST), np.clip(1 - (of((1 - p) * c) + 1) / (of((1 - p) * n) + 5), LEAST, MOST)
        moved = max(np.abs(new_se - se).max(), np.abs(new_sp - sp).max())
        se, sp = new_se, new_sp
        if moved < tolerance:
            return spark.createDataFrame(list(zip(names.tolist(), se.tolist(), sp.tolist())), QUALITY)
    raise RuntimeError(f"the witnesses' rates still move after {MOST_ROUNDS} rounds")


def _settled_there(long: DataFrame, base: float, newest_bonus: float, tolerance: float) -> DataFrame:
    """The same by joins, for any number of witnesses and patterns; a witness with many patterns is salted."""
    hot = hot_keys(long, ["w"])
    quality, path = written(long.select("w").distinct().select("w", F.lit(START).alias("se"), F.lit(START).alias("sp")), "quality")
    for _ in range(MOST_ROUNDS):
        p = _probabilities(long, quality, base, newest_bonus, hot)
        x = long.join(p, "pid")
        of = lambda e: F.sum(F.col("count") * F.expr(e))
        clip = lambda c: F.least(F.lit(MOST), F.greatest(F.lit(LEAST), c))
        rates = x.groupBy("w").agg(clip((of("p * c") + 4) / (of("p * n") + 5)).alias("se"), clip(1 - (of("(1 - p) * c") + 1) / (of("(1 - p) * n") + 5)).alias("sp"))
        new, new_path = written(rates.join(quality.toDF("w", "se0", "sp0"), "w").withColumn("moved", F.greatest(F.abs(F.col("se") - F.col("se0")), F.abs(F.col("sp") - F.col("sp0")))), "quality")
        moved = new.agg(F.max("moved")).first()[0]
        discard(long.sparkSession, path)
        quality, path = new.select("w", "se", "sp"), new_path
        if moved < tolerance:
            return quality
    raise RuntimeError(f"the witnesses' rates still move after {MOST_ROUNDS} rounds")


def _probabilities(long: DataFrame, quality: DataFrame, base: float, newest_bonus: float, hot: DataFrame | None = None) -> DataFrame:
    """(pid, p): the chance that a value is true, by its pattern."""
    x = long.join(F.broadcast(quality), "w") if small(quality) else salted_join(long, quality, ["w"], F.col("pid"), hot=hot)
    weight = F.sum(F.col("c") * F.log(F.col("se") / (1 - F.col("sp"))) + (F.col("n") - F.col("c")) * F.log((1 - F.col("se")) / F.col("sp")))
    logit = F.lit(base) + F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), weight)) + F.when(F.first("newest"), newest_bonus).otherwise(0.0)
    return x.groupBy("pid").agg((1.0 / (1.0 + F.exp(-logit))).alias("p"))


def survivors(values: DataFrame, least: float = 0.5) -> DataFrame:
    """The one value of each field: of those judged true (or, without one, the likeliest), the newest."""
    rank = F.struct((F.col("p") >= least).alias("kept"), F.when(F.col("p") < least, F.col("p")).alias("p"), "at", (-F.col("row_id")).alias("back"), "value")
    best = values.groupBy("gid", "field").agg(F.max(rank).alias("b"))
    return best.select("gid", "field", F.col("b.value").alias("value"), (-F.col("b.back")).alias("row_id"), F.col("b.at").alias("at"))
