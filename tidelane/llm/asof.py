"""Nearest record in time of the same entity, within a tolerance: expanding-ring joins.

Round k uses buckets of 2w seconds, w = start * 2^k. A left row looks into its own bucket only; each right row stands in
the two buckets that hold its time less w and its time plus w, so a left row sees every right row at most w away. What
it finds within w is provably the nearest and is accepted; the rest goes to the next, doubled round, up to the
tolerance. Within a bucket both sides are sorted by time together and the neighbours before and after are read off by
windows: linear work, and no pairs are made even where both sides are dense. The key holds the bucket, so an entity with
a third of all rows is spread over its time span.

Defined results: rows with null id, entity or time take no part; on the left, each id counts once, in its version of the
latest `version`; on the right, rows of one entity at one instant count as the smallest id; ties in distance go to the
smaller right id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.runtime import discard, written


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_s: float, start_s: float = 75.0) -> DataFrame:
    """(left_id, right_id, gap_us). left: (left_id, entity, t); right: (right_id, entity, t); t in epoch microseconds."""
    spark = left.sparkSession
    left = left.where("left_id is not null and entity is not null and t is not null")
    right = right.where("right_id is not null and entity is not null and t is not null").groupBy("entity", "t").agg(F.min("right_id").alias("right_id"))
    right, right_path = written(right, "asof-right")
    tolerance, w = round(tolerance_s * 1e6), min(round(start_s * 1e6), round(tolerance_s * 1e6))
    open_left, used, accepted = left, [], []
    while True:
        width = 2 * w if w < tolerance else 2 * tolerance
        half = width // 2
        rows = open_left.select("entity", F.floor(F.col("t") / width).cast("bigint").alias("bucket"), "t", "left_id", F.lit(None).cast(right.schema["right_id"].dataType).alias("right_id"))
        stands = F.array(F.floor((F.col("t") - half) / width).cast("bigint"), F.floor((F.col("t") + half) / width).cast("bigint"))
        near = right.select("entity", F.explode(F.array_distinct(stands)).alias("bucket"), "t", F.lit(None).cast(left.schema["left_id"].dataType).alias("left_id"), "right_id")
        both = rows.unionByName(near)
        by = Window.partitionBy("entity", "bucket")
        hit = F.when(F.col("right_id").isNotNull(), F.struct("t", "right_id"))
        # two running frames; a frame towards the end would cost its square
        seen = both.withColumn("before", F.last(hit, True).over(by.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)))
        seen = seen.withColumn("after", F.last(hit, True).over(by.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))).where("left_id is not null")
        ahead = F.struct((F.col("after.t") - F.col("t")).alias("gap"), F.col("after.right_id").alias("right_id"))
        behind = F.struct((F.col("t") - F.col("before.t")).alias("gap"), F.col("before.right_id").alias("right_id"))
        best = F.when(F.col("before").isNull(), ahead).when(F.col("after").isNull(), behind).otherwise(F.least(ahead, behind))
        found, path = written(seen.select("entity", "t", "left_id", best.alias("b")).select("entity", "t", "left_id", F.when(F.col("b.gap") <= half, F.col("b.gap")).alias("gap_us"), F.when(F.col("b.gap") <= half, F.col("b.right_id")).alias("right_id")), f"asof-{w}")
        used.append(path)
        accepted.append(found.where("gap_us is not null").select("left_id", "right_id", "gap_us"))
        open_left = found.where("gap_us is null").select("left_id", "entity", "t")
        if width >= 2 * tolerance or open_left.isEmpty():
            break
        w *= 2
    discard(spark, right_path)
    out = accepted[0]
    for part in accepted[1:]:
        out = out.unionByName(part)
    result, _ = written(out, "asof")
    discard(spark, *used)
    return result
