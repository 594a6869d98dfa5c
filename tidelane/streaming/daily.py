"""Incremental runs: new files are taken once, and each day they touch is made anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.sources.sinks import overwrite_days


def run_new_files(spark: SparkSession, source: str, schema: str, make: Callable[[DataFrame], DataFrame], target: str, state: str, day: str = "date") -> None:
    """Takes the files not seen before and overwrites the days they touch with make(all rows of those days).

    Idempotent: a run that failed half-way is repeated from the state folder, and days are overwritten whole.
    """

    def each(batch: DataFrame, _: int) -> None:
        days = batch.select(day).where(F.col(day).isNotNull()).distinct()
        if not days.isEmpty():
            rows = batch.sparkSession.read.schema(schema).parquet(source).join(F.broadcast(days), day, "left_semi")
            overwrite_days(make(rows), target, day)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def rolling_counts(stream: DataFrame, ts: str, keys: list[str], days: int = 24, late: str = "2 days") -> DataFrame:
    """Counts in windows of `days` that move by a day, over a stream or a table; rows later than `late` are dropped from a stream."""
    w = F.window(F.col(ts), f"{days} days", "1 day")
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")
