"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may hold; above it the callers take a shuffled path.
BROADCAST_ROWS = 50_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; only a local master may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tidelane-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def small(df: DataFrame) -> bool:
    """Whether a table may be broadcast; counts it."""
    return df.count() <= BROADCAST_ROWS


def kept_name(df: DataFrame, *settings) -> str | None:
    """A name for what is made of df with these settings, the same while the files it is read from stay the same; None without files."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.md5(repr((df.columns, settings)).encode())
    for f in files:
        p = jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(conf).getFileStatus(p)
        seen.update(repr((f, status.getLen(), status.getModificationTime())).encode())
    return seen.hexdigest()


def spread_out(df: DataFrame) -> DataFrame:
    """A table of a few files dealt over all cores, for work that is heavy for each row; a table of many splits as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


#: Share of all rows, and least number of rows, from which on a key counts as hot.
HOT_SHARE, HOT_ROWS = 0.002, 100_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame | None:
    """(keys, __salts): keys with more than `share` of the rows, and into how many pieces to split each; None without any.

    At most 1/share keys can qualify, so the list may be collected and broadcast whatever the input.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least)
    few = counts.orderBy(F.desc("__n")).limit(round(1 / share)).collect()
    if not few:
        return None
    floor = max(least, share * df.count())
    rows = [(*r[:-1], -(-r["__n"] // int(floor))) for r in few if r["__n"] > floor]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "__salts int"])
    return df.sparkSession.createDataFrame(rows, schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_by: Column, how: str = "inner", hot: DataFrame | None | bool = True) -> DataFrame:
    """Equi-join whose left side may hold hot keys; the right side has few rows for each key.

    The rows of a hot key are spread over __salts pieces by a hash of salt_by, and the matching right rows are repeated
    once per piece. hot: as hot_keys() gives it, or True to count here.
    """
    if hot is True:
        hot = hot_keys(left, keys)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    salted = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    spread = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
