"""Writing tables by day: overwrite, append, delete, describe, and which days are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.runtime import discard


def overwrite_days(df: DataFrame, path: str, day: str = "date") -> None:
    """Replaces just the days that df holds; running it again changes nothing."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append(df: DataFrame, path: str, day: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(day) if day else w).parquet(path)


def delete_day(spark: SparkSession, path: str, value: str, day: str = "date") -> None:
    discard(spark, f"{path.rstrip('/')}/{day}={value}")


def describe(spark: SparkSession, table: str, text: str) -> None:
    """A table's comment, such as where its rows come from."""
    spark.sql(f"COMMENT ON TABLE {table} IS '{text.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'")


def missing_days(raw: DataFrame, done: DataFrame, day: str = "date") -> DataFrame:
    """Days of raw that done hasn't."""
    return raw.select(F.col(day).cast("date").alias(day)).distinct().where(F.col(day).isNotNull()).join(done.select(F.col(day).cast("date").alias(day)).distinct(), day, "left_anti")


def as_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def as_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
