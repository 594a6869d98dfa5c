"""Groups of records linked directly or indirectly: randomised contraction of the graph of pairs.

Each round gives every vertex a fresh pseudo-random order (a seeded hash). Every vertex hooks to the neighbour, or
itself, that comes first; edges are relabelled to these representatives, loops dropped, repeats removed. A constant
share of the vertices vanishes each round in expectation, whatever the shape of the graph, so long chains take a
logarithmic number of rounds. When no edge is left, the rounds' mappings are expanded backwards.

Each round is an aggregation (with map-side combine, so a vertex with a third of all pairs is no burden) and two joins
of the edges to one row per vertex, where hot vertices are salted. Edges and mappings are written to the shared folder.

Defined results: null ids, loops and repeated pairs are ignored, in either order; vertices without a link are not in the
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.runtime import HOT_ROWS, HOT_SHARE, discard, salted_join, written


def connected_components(pairs: DataFrame, a: str, b: str, seed: int = 17, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) as text; component is the smallest vertex (by bytes) of its group."""
    spark = pairs.sparkSession
    u, v = F.col(a).cast("string"), F.col(b).cast("string")
    first = pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct()
    edges, path = written(first, "edges0")
    maps: list[tuple[DataFrame, DataFrame | None]] = []
    used: list[str] = []
    for r in range(max_rounds):
        n = edges.count()
        if not n:
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        near = ends.groupBy("x").agg(F.min(F.struct(F.xxhash64(F.lit(seed + r), "y").alias("h"), F.col("y").alias("k"))).alias("n"), F.count(F.lit(1)).alias("degree"))
        own = F.struct(F.xxhash64(F.lit(seed + r), "x").alias("h"), F.col("x").alias("k"))
        hooks, hooks_path = written(near.select("x", F.least(own, F.col("n"))["k"].alias("rep"), "degree"), f"hooks{r}")
        used.append(hooks_path)
        mapping = hooks.select("x", "rep")
        # at most 2 n / floor vertices are that hot
        floor = max(HOT_ROWS, int(HOT_SHARE * n))
        few = hooks.where(F.col("degree") > floor).select("x", F.ceil(F.col("degree") / floor).cast("int").alias("__salts"))
        hot = None if few.isEmpty() else few
        # no more vertices hook to a vertex than it has neighbours, so these are the hot ones on the way back too
        maps.append((mapping, hot))
        half = salted_join(edges, mapping.toDF("u", "ru"), ["u"], F.col("v"), hot=hot and hot.toDF("u", "__salts"))
        full = salted_join(half.select("ru", "v"), mapping.toDF("v", "rv"), ["v"], F.col("ru"), hot=hot and hot.toDF("v", "__salts"))
        kept, new_path = written(full.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), f"edges{r + 1}")
        discard(spark, path)
        edges, path = kept, new_path
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    discard(spark, path)
    if not maps:
        return spark.createDataFrame([], "vertex string, component string")
    # backwards: a representative of round r may itself have been mapped in a later round
    final = maps[-1][0]
    for earlier, hot in maps[-2::-1]:
        joined = salted_join(earlier, final.toDF("rep", "top"), ["rep"], F.col("x"), "left", hot and hot.toDF("rep", "__salts"))
        final = joined.select("x", F.coalesce("top", "rep").alias("rep"))
    final, path = written(final, "members")
    sizes, sizes_path = written(final.groupBy("rep").agg(F.min("x").alias("low"), F.count(F.lit(1)).alias("n")), "groups")
    floor = max(HOT_ROWS, int(HOT_SHARE * final.count()))
    few = sizes.where(F.col("n") > floor).select("rep", F.ceil(F.col("n") / floor).cast("int").alias("__salts"))
    tree = salted_join(final, sizes.select("rep", "low"), ["rep"], F.col("x"), hot=None if few.isEmpty() else few)
    result, _ = written(tree.select(F.col("x").alias("vertex"), F.least("low", "rep").alias("component")), "components")
    discard(spark, *used, path, sizes_path)
    return result
