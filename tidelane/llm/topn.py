"""The N best items of every group by statistics-guided skipping.

Rows are clustered once: range-partitioned by (group, falling score) and sorted, so a file holds few groups, and a group
with a third of all rows spans many files. This layout is kept for later runs, for any N, where the caller names a place.
Row groups are small, and their footers say which groups and scores they hold. A task takes consecutive files and visits
the row groups of each in falling order of maximum score. It skips a row group when its maximum lies strictly below the
current N-th score of every group in it; where the footer doesn't say that there is one group alone, the column of groups
is read to see. A last aggregation joins the tasks' winners, at most N rows of a group from each file.

Defined results: rows with a null in a key, or a null or NaN score, don't count; infinite scores count; a repeated item
counts once with its highest score; ties go to the smaller item keys, in the order given; groups with fewer than N items
give what they have; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.runtime import discard, kept_name, shared_folder, written


def _files(path: str) -> list[str] | None:
    """The files of a finished layout in order; None without one."""
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{root}/_SUCCESS").type == pafs.FileType.NotFound:
        return None
    return sorted(f"{path}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))


def cluster(df: DataFrame, group: str, items: list[str], score: str, path: str, row_group_bytes: int = 1 << 20) -> None:
    """Writes the layout: g, i0, i1, ... as text and score, ordered by g and falling score through all files."""
    keys = [F.col(c).cast("string").alias(f"i{k}") for k, c in enumerate(items)]
    rows = df.select(F.col(group).cast("string").alias("g"), *keys, F.col(score).cast("double").alias("score")).dropna().where(~F.isnan("score"))
    ordered = rows.repartitionByRange("g", F.desc("score"), *rows.columns[1:-1]).sortWithinPartitions("g", F.desc("score"))
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def top_n(df: DataFrame, group: str, items: list[str], score: str, n: int, row_group_bytes: int = 1 << 20, keep: bool = False) -> DataFrame:
    """(group, *items, score, rank) of the n best items of each group; group and items come out as text.

    keep: the layout stays in the shared folder, and is used again while df's files stay the same. df must then be those files' rows.
    """
    spark = df.sparkSession
    name = kept_name(df, group, items, score, row_group_bytes) if keep else None
    path = f"{shared_folder(spark)}/clustered-{name or uuid.uuid4().hex}"
    if name is None or _files(path) is None:
        cluster(df, group, items, score, path, row_group_bytes)
    out = best_of(spark, path, len(items), n).toDF(group, *items, score, "rank")
    result, _ = written(out, "topn")
    if name is None:
        discard(spark, path)
    return result


def best_of(spark: SparkSession, path: str, items: int, n: int) -> DataFrame:
    """(g, i0, i1, ..., score, rank) of the n best items of each group of a layout."""
    files = _files(path)
    keys = [f"i{k}" for k in range(items)]
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    schema = ", ".join(["g string", *[f"{k} string" for k in keys], "score double"])
    winners = spark.range(0, len(files), 1, tasks).mapInArrow(lambda it: _visit((files[i] for b in it for i in b["id"].to_pylist()), keys, n), schema)
    best = winners.groupBy("g", *keys).agg(F.max("score").alias("score"))
    rank = Window.partitionBy("g").orderBy(F.desc("score"), *keys)
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def _visit(files, keys: list[str], n: int):
    """Winners of each file. The N-th score of the last group goes over to the next file, which may go on with it."""
    nth: dict[str, float] = {}
    for file in files:
        fs, name = pafs.FileSystem.from_uri(file)
        source = pq.ParquetFile(fs.open_input_file(name))
        held = [best for _, best in _read(source, keys, n, nth) if best is not None]
        if held:
            best = winners_of(pa.concat_tables(held), keys, n)
            last = pc.max(best["g"]).as_py()
            nth = {last: nth[last]} if last in nth else {}
            yield from best.to_batches()


def _read(source: pq.ParquetFile, keys: list[str], n: int, nth: dict[str, float]):
    """(row group, its winners or None where it is skipped) in falling order of maximum score; nth gets the groups' N-th scores."""
    meta = source.metadata
    names = [meta.schema.column(i).name for i in range(meta.num_columns)]
    g, s = names.index("g"), names.index("score")
    chunks = []
    for i in range(meta.num_row_groups):
        a, b = meta.row_group(i).column(g).statistics, meta.row_group(i).column(s).statistics
        known = a is not None and a.has_min_max and b is not None and b.has_min_max
        chunks.append((b.max if known else float("inf"), i, a.min if known else None, a.max if known else None))
    for most, i, low, high in sorted(chunks, key=lambda c: (-c[0], c[1])):
        # the first and last group are in it for certain, so both must have an N-th score before the others are looked at
        if low in nth and high in nth and most < min(nth[low], nth[high]):
            groups = [low] if low == high else pc.unique(source.read_row_group(i, columns=["g"])["g"]).to_pylist()
            if all(x in nth and most < nth[x] for x in groups):
                yield i, None
                continue
        best = winners_of(source.read_row_group(i), keys, n)
        _note(best, nth, n)
        yield i, best


def winners_of(t: pa.Table, keys: list[str], n: int) -> pa.Table:
    """The n best different items of each group of a table, ordered by group and rank."""
    best = t.group_by(["g", *keys]).aggregate([("score", "max")]).rename_columns(["g", *keys, "score"])
    best = best.sort_by([("g", "ascending"), ("score", "descending"), *((k, "ascending") for k in keys)])
    return best.filter(pa.array(_rank(best) < n))


def _rank(best: pa.Table) -> np.ndarray:
    code = np.asarray(best["g"].combine_chunks().dictionary_encode().indices)
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.array([], int)
    return np.arange(len(code)) - np.repeat(start, np.diff([*start, len(code)]))


def _note(best: pa.Table, nth: dict[str, float], n: int) -> None:
    full = best.filter(pa.array(_rank(best) == n - 1))
    for g, s in zip(full["g"].to_pylist(), full["score"].to_pylist()):
        nth[g] = max(s, nth.get(g, s))
