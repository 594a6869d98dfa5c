"""Percentiles per group from mergeable summaries: deterministic collapsing of equal-size weighted sorted buffers.

A summary holds buffers of k sorted values at levels 0, 1, 2, ...; a value at level l stands for 2^l values. Two full
buffers of a level merge: their 2k values are sorted and every second one is kept, at even and odd places in turn, as
one buffer of the next level. What doesn't fill a buffer stays exact, at weight 1 (the tail). A collapse at level l moves
any rank by at most 2^l, and at most n / (2^(l+1) k) of them happen there, so the rank error is at most
n * levels / (2k), a share of levels / (2k) of all values, with levels = ceil(log2(n / k)). With k = 512 that is below
3 % up to n = 512 * 2^30 values.

Building, merging and reading are deterministic for a given order of input partitions. Each task summarises its rows
first; the summaries of a group, at most one from each task, are merged in a tree: `fan` at a time.

Defined results: null and NaN values and null groups don't count; a group without values is absent; ties are plain
values; a single value is every percentile; infinite values count; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row per buffer: level -1 is the tail, others are full buffers; turn is the next place (0 even, 1 odd) to keep there.
SUMMARY = "n bigint, level int, turn int, vals array<double>"


class Summary:
    """Buffers by level, the tail of single values, and for each level the turn of its next collapse."""

    def __init__(self, k: int):
        self.k, self.n, self.tail, self.full, self.turn = k, 0, np.empty(0), {}, {}

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.tail = np.concatenate([self.tail, values])
        while len(self.tail) >= self.k:
            self._push(0, np.sort(self.tail[: self.k]))
            self.tail = self.tail[self.k :]

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            both = np.sort(np.concatenate([self.full.pop(level), buffer]))
            t = self.turn.get(level, 0)
            self.turn[level] = 1 - t
            buffer, level = both[t::2], level + 1
        self.full[level] = buffer

    def merge(self, other: Summary) -> None:
        n = self.n + other.n
        self.add(other.tail)
        for level in sorted(other.full):
            self._push(level, other.full[level])
        self.n = n

    def rows(self) -> list[tuple]:
        out = [(self.n, level, self.turn.get(level, 0), self.full[level]) for level in sorted(self.full)]
        return out + ([(self.n, -1, 0, np.sort(self.tail))] if len(self.tail) or not out else [])

    @staticmethod
    def of(k: int, rows) -> Summary:
        s = Summary(k)
        for n, level, turn, vals in rows:
            s.n = n
            if level < 0:
                s.tail = np.asarray(vals, float)
            else:
                s.full[level], s.turn[level] = np.asarray(vals, float), turn
        return s

    def size(self) -> int:
        """Values held."""
        return len(self.tail) + sum(map(len, self.full.values()))

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(self.tail, 1), *((b, 1 << level) for level, b in self.full.items())]
        v = np.concatenate([p for p, _ in parts])
        w = np.concatenate([np.full(len(p), x, float) for p, x in parts])
        order = np.argsort(v, kind="stable")
        return v[order], w[order]

    def quantile(self, q: float) -> float:
        """Interpolated between the two values around rank q (n - 1), as the exact percentile is."""
        v, w = self.weighted()
        last = np.cumsum(w) - 1
        r = q * (self.n - 1)
        lo, hi = np.searchsorted(last, np.floor(r)), np.searchsorted(last, np.ceil(r))
        lo, hi = min(lo, len(v) - 1), min(hi, len(v) - 1)
        if lo == hi or v[lo] == v[hi]:
            return float(v[lo])
        return float(v[lo] + (r - np.floor(r)) * (v[hi] - v[lo]))


def rank_error(n: int, k: int) -> float:
    """Largest share of n values that a percentile from a summary may be off."""
    levels = max(0, int(np.ceil(np.log2(max(1.0, n / k)))))
    return levels / (2 * k)


def summaries(df: DataFrame, groups: list[str], value: str, k: int = 512, fan: int = 256) -> DataFrame:
    """(groups as text, SUMMARY): one mergeable summary for each group, as one row per buffer."""
    keys = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(c).cast("string").alias(g) for c, g in zip(groups, keys)], F.col(value).cast("double").alias("v")).dropna().where(~F.isnan("v"))
    schema = ", ".join([*(f"{g} string" for g in keys), "piece bigint", SUMMARY])
    parts = rows.withColumn("piece", F.spark_partition_id().cast("bigint")).mapInArrow(lambda it: _build(it, keys, k), schema)
    # the tree: `fan` tasks' summaries first, then theirs
    inner = parts.withColumn("piece", F.floor(F.col("piece") / fan).cast("bigint"))
    inner = inner.repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", "level", "vals").mapInArrow(lambda it: _merge(it, [*keys, "piece"], keys, k), schema)
    return merge_summaries(inner.drop("piece").toDF(*groups, "n", "level", "turn", "vals"), groups, k)


def merge_summaries(parts: DataFrame, groups: list[str], k: int = 512) -> DataFrame:
    """Summaries of separate days or partitions (any union of summaries() rows) as one for each group."""
    keys = [f"g{i}" for i in range(len(groups))]
    schema = ", ".join([*(f"{g} string" for g in keys), "piece bigint", SUMMARY])
    named = parts.select(*[F.col(c).alias(g) for c, g in zip(groups, keys)], "n", "level", "turn", "vals")
    ordered = named.repartition(*keys).sortWithinPartitions(*keys, "level", "vals")
    return ordered.mapInArrow(lambda it: _merge(it, keys, keys, k), schema).drop("piece").toDF(*groups, "n", "level", "turn", "vals")


def percentiles(parts: DataFrame, groups: list[str], qs: list[float], k: int = 512) -> DataFrame:
    """(groups, n, q0, q1, ...) read off summaries."""
    keys = [f"g{i}" for i in range(len(groups))]
    schema = ", ".join([*(f"{g} string" for g in keys), "n bigint", *(f"q{i} double" for i in range(len(qs)))])
    named = parts.select(*[F.col(c).alias(g) for c, g in zip(groups, keys)], "n", "level", "turn", "vals")

    def read(batches):
        rows = []
        for key, group in _runs(batches, keys, ["n", "level", "turn", "vals"]):
            s = Summary.of(k, group)
            rows.append((*key, s.n, *(s.quantile(q) for q in qs)))
        if rows:
            types = [*[pa.string()] * len(keys), pa.int64(), *[pa.float64()] * len(qs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*keys, "n", *(f"q{i}" for i in range(len(qs)))])

    ordered = named.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(read, schema).toDF(*groups, "n", *(f"q{i}" for i in range(len(qs))))


def _runs(batches, keys: list[str], columns: list[str]):
    """Rows of each run of equal keys; lists of values as arrays."""

    def values(batch, c):
        if not pa.types.is_list(batch.schema.field(c).type):
            return batch[c].to_pylist()
        flat, at = batch[c].values.to_numpy(zero_copy_only=False), batch[c].offsets.to_numpy()
        return [flat[i:j] for i, j in zip(at, at[1:])]

    last, held = None, []
    for batch in batches:
        for row in zip(*(values(batch, c) for c in [*keys, *columns])):
            key = row[: len(keys)]
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row[len(keys) :])
    if held:
        yield last, held


def _emit(keys: list[str], found):
    rows = [(*key, piece, *r) for key, piece, s in found for r in s.rows()]
    if rows:
        types = [*[pa.string()] * len(keys), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*keys, "piece", "n", "level", "turn", "vals"])


#: What the open summaries of a task may take, and what one takes beside its values.
HELD_BYTES, SUMMARY_BYTES = 64 << 20, 2_000


def _build(batches, keys: list[str], k: int):
    open_: dict[tuple, Summary] = {}
    piece = held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch["piece"][0].as_py()
        t = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("v", "list")])
        lists = t["v_list"].combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        for i, key in enumerate(zip(*(t[g].to_pylist() for g in keys))):
            s = open_.setdefault(key, Summary(k))
            before = s.size()
            s.add(flat[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]])
            held += 8 * (s.size() - before)
        if held + SUMMARY_BYTES * len(open_) > HELD_BYTES:  # hand over what there is; it is merged later
            yield from _emit_all(keys, piece, open_)
            open_, held = {}, 0
    yield from _emit_all(keys, piece, open_)


def _emit_all(keys: list[str], piece: int, open_: dict[tuple, Summary]):
    """All open summaries, a thousand to a batch."""
    all_ = list(open_.items())
    for a in range(0, len(all_), 1000):
        yield from _emit(keys, ((key, piece, s) for key, s in all_[a : a + 1000]))


def _merge(batches, by: list[str], keys: list[str], k: int):
    """One summary for each run of `by`. A buffer counts for itself, with n from its size, so sources needn't be told apart."""
    done = []
    for key, rows in _runs(batches, by, ["level", "vals"]):
        whole = Summary(k)
        for level, vals in rows:
            whole.merge(Summary.of(k, [(len(vals) << max(level, 0), level, 0, vals)]))
        done.append((key[: len(keys)], key[len(keys)] if len(key) > len(keys) else 0, whole))
        if len(done) > 2000:
            yield from _emit(keys, done)
            done = []
    yield from _emit(keys, done)
