"""Clusters of structures: density clusters, lifetimes, repeated objects, relabelling and ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.compat import month_diff
from tidelane.operators.proximity import distance_join, near_pairs
from tidelane.runtime import HOT_ROWS, HOT_SHARE, discard, salted_join, written


def labelled(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label): the smallest id of each vertex's component. edges: id_a, id_b.

    Rounds of contraction: a vertex joins the first of itself and its neighbours in an order that changes with the
    round, edges move to the survivors, loops go. Long chains thus take a logarithmic number of rounds.
    """
    spark = edges.sparkSession
    left, path = written(edges.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a < b").distinct(), "edges")
    steps: list[tuple[DataFrame, DataFrame | None]] = []
    used: list[str] = []
    for r in range(max_rounds):
        order = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ends = left.union(left.select("b", "a"))
        first = ends.groupBy(F.col("a").alias("id")).agg(F.min(order("b")).alias("n"), F.count(F.lit(1)).alias("degree"))
        step, step_path = written(first.select("id", F.least(order("id"), F.col("n"))["v"].alias("to"), "degree"), "step")
        used.append(step_path)
        # no more vertices join a vertex than it has neighbours, so these are hot here and on the way back
        hot = _hot(step, "id", "degree", left.count())
        to = step.select("id", "to")
        steps.append((to, hot))
        half = salted_join(left, to.toDF("a", "x"), ["a"], F.col("b"), hot=hot and hot.toDF("a", "__salts"))
        moved = salted_join(half, to.toDF("b", "y"), ["b"], F.col("x"), hot=hot and hot.toDF("b", "__salts")).where("x <> y")
        new, new_path = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(spark, path)
        left, path = new, new_path
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    end = steps[-1][0]
    for step, hot in steps[-2::-1]:
        end = salted_join(step, end.toDF("to", "top"), ["to"], F.col("id"), "left", hot and hot.toDF("to", "__salts")).select("id", F.coalesce("top", "to").alias("to"))
    end, end_path = written(end, "members")
    low, low_path = written(end.groupBy("to").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "lowest")
    hot = _hot(low, "to", "n", end.count())
    result, _ = written(salted_join(end, low.select("to", "low"), ["to"], F.col("id"), hot=hot).select("id", F.least("low", "to").alias("label")), "labels")
    discard(spark, path, *used, end_path, low_path)
    return result


def _hot(counts: DataFrame, key: str, n: str, whole: int) -> DataFrame | None:
    """(key, __salts) of the keys with many of `whole` rows, for salted_join()."""
    floor = max(HOT_ROWS, int(HOT_SHARE * whole))
    few = counts.where(F.col(n) > floor).select(key, F.ceil(F.col(n) / floor).cast("int").alias("__salts"))
    return None if few.isEmpty() else few


def dbscan(points: DataFrame, eps_m: float, min_pts: int = 1) -> DataFrame:
    """(id, cluster) of points (id, lat, lon): cluster is the smallest id of its core points; null for noise.

    Core points have min_pts points within eps_m (themselves included); cores within reach share a cluster; another
    point in reach of a core joins the smallest such cluster.
    """
    near = near_pairs(points, eps_m * (1 + 1e-12)).select("id_a", "id_b")
    near, _ = written(near, "near")
    both = near.union(near.select("id_b", "id_a"))
    if min_pts <= 2:
        cores = points.select("id") if min_pts <= 1 else both.select(F.col("id_a").alias("id")).distinct()
        linked = labelled(near)
        return points.select("id").join(linked, "id", "left").join(cores.withColumn("core", F.lit(True)), "id", "left").select("id", F.coalesce("label", F.when(F.col("core"), F.col("id"))).alias("cluster"))
    cores = both.groupBy(F.col("id_a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pts - 1).select("id")
    inner = near.join(cores.toDF("id_a"), "id_a", "left_semi").join(cores.toDF("id_b"), "id_b", "left_semi")
    core_label = cores.join(labelled(inner), "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))
    edge = both.join(core_label.toDF("id_b", "cluster"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.min("cluster").alias("reach"))
    return points.select("id").join(core_label, "id", "left").join(edge, "id", "left").select("id", F.coalesce("cluster", "reach").alias("cluster"))


def centroids(points: DataFrame, by: str) -> DataFrame:
    """(by, lat, lon): centre of each group's points by the mean of their unit vectors, so the date line and poles do no harm."""
    la, lo = F.radians("lat"), F.radians("lon")
    g = points.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(F.cos(la) * F.cos(lo)).alias("x"), F.avg(F.cos(la) * F.sin(lo)).alias("y"), F.avg(F.sin(la)).alias("z"))
    return g.select(by, F.degrees(F.atan2("z", F.sqrt(F.pow("x", 2) + F.pow("y", 2)))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))


def nearest(left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, r_<right_id>, distance_m): the nearest right row within the radius; ties to the smaller id."""
    met = distance_join(left.select(left_id, "lat", "lon"), right.select(right_id, "lat", "lon").toDF(f"r_{right_id}", "lat", "lon"), radius_m)
    return met.groupBy(left_id).agg(F.min(F.struct("distance_m", f"r_{right_id}")).alias("m")).select(left_id, f"m.r_{right_id}", "m.distance_m")


def lifetimes(df: DataFrame, key: str, month: str, gap: int = 2, least: int = 2) -> DataFrame:
    """(key, subcluster, midpoint, seen, cluster_start, cluster_end, sub_start, sub_end): each cluster's months in runs without a gap of over `gap`, single-month runs left out, missing months filled in."""
    m = df.select(key, F.col(month).cast("date").alias("midpoint")).dropna().distinct()
    w = Window.partitionBy(key).orderBy("midpoint")
    new = F.coalesce(month_diff(F.lag("midpoint").over(w), F.col("midpoint")) > gap, F.lit(True))
    m = m.withColumn("subcluster", F.sum(new.cast("bigint")).over(w))
    sub = m.groupBy(key, "subcluster").agg(F.min("midpoint").alias("sub_start"), F.max("midpoint").alias("sub_end"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    whole = Window.partitionBy(key)
    sub = sub.withColumns({"cluster_start": F.min("sub_start").over(whole), "cluster_end": F.max("sub_end").over(whole)})
    every = sub.withColumn("midpoint", F.explode(F.sequence("sub_start", "sub_end", F.expr("interval 1 month"))))
    out = every.join(m.select(key, "midpoint", F.lit(True).alias("seen")), [key, "midpoint"], "left")
    return out.select(key, "subcluster", "midpoint", F.coalesce("seen", F.lit(False)).alias("seen"), "cluster_start", "cluster_end", "sub_start", "sub_end")


def top_label(*classes: str) -> Column:
    """Name of the largest of the columns, the first on a tie; null if any is null."""
    most = F.greatest(*[F.col(c) for c in classes])
    out = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in classes]) == 1, F.lit(None).cast("string"))
    for c in classes:
        out = out.when(F.col(c) == most, c)
    return out


def averaged_label(df: DataFrame, by: list[str], classes: tuple[str, ...]) -> DataFrame:
    """(by, classes, label): mean scores of each group and the class with the largest."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in classes]).withColumn("label", top_label(*classes))


def relabel(df: DataFrame, rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, label in rules[1:]:
        out = out.when(condition, label)
    return out.otherwise(default)


def spread_label(df: DataFrame, id_col: str, label: str, value: str, from_label: str, radius_m: float, hops: int = 3) -> DataFrame:
    """df where rows labelled from_label take `value` if a row with it lies within the radius, `hops` times over."""
    cur, _ = written(df, "spread0")
    for k in range(hops):
        have = cur.where(F.col(label) == value).select("lat", "lon").distinct().toDF("lat", "lon")
        open_ = cur.where(F.col(label) == from_label).select(id_col, "lat", "lon")
        hit = distance_join(open_, have, radius_m).select(id_col).distinct().withColumn("__hit", F.lit(True))
        cur, _ = written(cur.join(hit, id_col, "left").withColumn(label, F.when(F.col("__hit"), value).otherwise(F.col(label))).drop("__hit"), f"spread{k + 1}")
    return cur


def ambiguous(by_angle: str, often: float = 0.9, rarely: float = 0.1, least: int = 5) -> Column:
    """True where a structure is seen nearly always from one angle and hardly ever from another, each with enough overpasses."""
    share = lambda a: F.try_divide(a["detections"].cast("double"), a["overpasses"].cast("double"))
    enough = lambda a: a["overpasses"] > least
    c = F.col(by_angle)
    return F.coalesce((F.size(c) > 1) & F.exists(c, lambda a: enough(a) & (share(a) > often)) & F.exists(c, lambda a: enough(a) & (share(a) < rarely)), F.lit(False))
