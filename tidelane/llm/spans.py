"""Stretches of at least `length` characters that stand verbatim in another record, by recompression.

Each text is parsed level by level as in recompression: runs of one symbol become a symbol, and so do pairs of a
"left" and a "right" symbol, the class of a symbol being a bit of its name. A name is a 64-bit fingerprint of what the
symbol stands for, so equal content gets equal names in all records without a dictionary. With every symbol goes the
stretch of text that its making depends on; where a window of `length` characters covers that stretch, the symbol
appears in every copy of the window. Of the top level, each symbol whose name is smaller than both its neighbours' goes
out with them as one landmark: a third of the symbols, and again a matter of content alone.

Round 1 names landmarks over the corpus: which stand in two different texts. Runs of shared landmarks become
stretches; windows outside them cover an unshared landmark and can't be shared. Only texts with stretches go on.
Round 2 cuts the stretches at symbols and names the pieces by 128-bit hashes of their characters: a piece that stands
in two texts is shared as a whole. Round 3 takes the pieces that aren't, most of them the ragged ends, window by window,
against each other and against one copy of every piece that is.
Touching pieces and windows unite. No text is held against another, so a passage in a third of all records costs no more
than any other.

Texts that are equal form a class, are matched once, and are shared as a whole.

Defined results: null, empty and shorter texts have no spans; positions are code points, ends exclusive; text repeated
only within its own record doesn't count; records with a null id take no part; repeated ids count as one record for each
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.runtime import BROADCAST_ROWS, HOT_ROWS, HOT_SHARE, discard, salted_join, spread_out, written

#: Levels of pair naming (each shortens a text to about three quarters), and how often runs are named first.
LEVELS, RUN_EVERY = 8, 6
#: Code points parsed at once: arrays of that size stay near the core.
CHUNK = 120_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _name(a, b, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(a * np.uint64(0x9E3779B97F4A7C15) + (b + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F))


#: Names of the first 65536 code points.
_FIRST = _mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def parse(code: np.ndarray, wall: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, ...]:
    """(name, start, low, high) of the top level's symbols; wall marks places between texts, which join nothing.

    [low, high) is the stretch on which a symbol's making depends; past a wall it takes the wall in.
    """
    with np.errstate(over="ignore"):
        name = _FIRST[code] if code.max(initial=0) < 65536 else _mix((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    start = np.arange(len(code), dtype=np.int32)
    low, high = start, start + np.int32(1)
    for level in range(levels):
        n = len(name)
        if n < 2:
            break
        if level % RUN_EVERY == 0:
            same = (name[1:] == name[:-1]) & ~wall[1:] & ~wall[:-1]
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            tail = np.concatenate([head[1:], [n]]) - 1
            low, high = low[np.maximum(head - 1, 0)], high[np.minimum(tail + 1, n - 1)]
            long = np.flatnonzero(tail > head)
            new = name[head]
            new[long] = _name(new[long], (tail - head + 1)[long].astype(np.uint64), 1000 + level)
            name, start, wall, n = new, start[head], wall[head], len(head)
        # names are fingerprints, so a bit of them serves as the class, another one on each level
        right = (name >> np.uint64(level + 1)) & np.uint64(1) == 1
        pair = np.zeros(n, bool)
        np.logical_and(~right[:-1], right[1:], out=pair[:-1])
        pair[:-1] &= ~(wall[:-1] | wall[1:])
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        keep = np.flatnonzero(~second)
        p, r = pair[keep], right[keep]
        new = name[keep]
        at = np.flatnonzero(p)
        new[at] = _name(new[at], name[keep[at] + 1], level)
        # alone: a left symbol depends on what follows it, a right symbol on what precedes it
        alone_right = r & ~p
        low = low[np.where(alone_right, np.maximum(keep - 1, 0), keep)]
        high = high[np.where(alone_right, keep, np.minimum(keep + 1, n - 1))]
        name, start, wall = new, start[keep], wall[keep]
    text = np.flatnonzero(~wall)
    return name[text], start[text], low[text], high[text]


def landmarks(code: np.ndarray, wall: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, text, low, high): each top-level symbol with the smallest name among its neighbours of the same text, together with them."""
    name, start, low, high = parse(code, wall)
    of = np.searchsorted(starts, start, side="right") - 1
    k = np.flatnonzero((of[:-2] == of[2:]) & (name[1:-1] < name[:-2]) & (name[1:-1] <= name[2:]))
    return _name(_name(name[k], name[k + 1], 51), name[k + 2], 52), of[k], low[k], high[k + 2]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts with a wall before, between and behind, the walls, and where each text starts."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(np.concatenate([[0], sizes[:-1]])) + np.arange(1, len(parts) + 1)
    code = np.zeros(int(sizes.sum()) + len(parts) + 1, dtype="<u4")
    for p, s in zip(parts, starts):
        code[s : s + len(p)] = p
    wall = np.zeros(len(code), bool)
    wall[0] = True
    wall[starts + sizes] = True
    return code, wall, starts


def _chunks(batches, text: str):
    """(row numbers within the batch, texts) of about CHUNK code points, with the batch."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        rows, texts, size = [], [], 0
        for i in range(batch.num_rows):
            rows.append(i)
            texts.append(column[i].as_py())
            size += len(texts[-1]) + 1
            if size >= CHUNK:
                yield batch, rows, texts
                rows, texts, size = [], [], 0
        if rows:
            yield batch, rows, texts


def _emit_landmarks(batches, length: int):
    """(c1, c2, doc, k, name, a, b): the k-th landmark of a text; without its neighbours' names shared, windows from a to b may be. Name null: a window from a to b covers no landmark."""
    for batch, rows, texts in _chunks(batches, "text"):
        code, wall, starts = _joined(texts)
        name, of, low, high = landmarks(code, wall, starts)
        narrow = high - low <= length
        name, of = name[narrow], of[narrow]
        sizes = np.diff(np.append(starts, len(code))) - 1
        # what reaches past a wall stands in no window, however far
        low, high = np.maximum(low[narrow] - starts[of], -1), np.minimum(high[narrow] - starts[of], sizes[of] + 1)
        first = np.searchsorted(of, np.arange(len(rows) + 1))
        k = np.arange(len(of)) - first[of]
        head, tail = k == 0, np.append(of[1:] != of[:-1], True)[: len(of)]
        before = np.where(head, -1, np.concatenate([[0], low[:-1]])[: len(of)])
        after = np.where(tail, sizes[of] + 1, np.concatenate([high[1:], [0]])[: len(of)])
        # windows between two neighbours that cover neither, and those before the first and behind the last
        gap_of, gap_a, gap_b = np.concatenate([of, of[tail]]), np.concatenate([before + 1, low[tail] + 1]), np.concatenate([high - length - 1, sizes[of[tail]] - length])
        bare = np.flatnonzero(np.diff(first) == 0)
        gap_of, gap_a, gap_b = np.concatenate([gap_of, bare]), np.concatenate([gap_a, np.zeros(len(bare), int)]), np.concatenate([gap_b, sizes[bare] - length])
        gap = np.flatnonzero(gap_a <= gap_b)
        names = pa.concat_arrays([pa.array(name.view(np.int64)), pa.nulls(len(gap), pa.int64())])
        owner = pa.array(np.asarray(rows)[np.concatenate([of, gap_of[gap]])])
        numbers = [np.concatenate(x).astype(np.int32) for x in ((k, np.zeros(len(gap), int)), (before + 1, gap_a[gap]), (after - length - 1, gap_b[gap]))]
        yield pa.RecordBatch.from_arrays([*(batch[c].take(owner) for c in ("c1", "c2", "doc")), pa.array(numbers[0]), names, pa.array(numbers[1]), pa.array(numbers[2])], ["c1", "c2", "doc", "k", "name", "a", "b"])


def _hashed(code: np.ndarray, first: np.ndarray, behind: np.ndarray) -> list[pa.Array]:
    """128-bit hashes of the characters from first to behind, as two columns."""
    view = memoryview(np.ascontiguousarray(code)).cast("B")
    digests = [xxhash.xxh3_128_digest(view[4 * i : 4 * j]) for i, j in zip(first.tolist(), behind.tolist())]
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _emit_pieces(batches, length: int, cut: bool):
    """(c1, c2, known, a, b, h1, h2) of runs of windows a to b, hashed over all their characters: stretches cut at symbols, or single windows."""
    for batch, rows, texts in _chunks(batches, "text"):
        code, wall, starts = _joined(texts)
        lists = batch["at"].take(pa.array(rows))
        of = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
        flat = lists.flatten()
        a, b = (np.asarray(flat.field(c)).astype(np.int64) + starts[of] for c in ("a", "b"))
        # united where they overlap
        order = np.lexsort((a, of))
        of, a, b = of[order], a[order], np.maximum.accumulate(b[order])
        new = np.concatenate([[True], a[1:] > b[:-1]])
        head = np.flatnonzero(new)
        of, a, b = of[head], a[head], b[np.append(head[1:], len(b)) - 1]
        if cut:
            start = parse(code, wall)[1]
            run = np.searchsorted(a, start, side="right") - 1
            inside = (run >= 0) & (start > a[run]) & (start <= b[run])
            first = np.sort(np.concatenate([a, start[inside]]))
        else:
            first = np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)])
        run = np.searchsorted(a, first, side="right") - 1
        last = np.where(np.append(run[1:] != run[:-1], True), b[run], np.append(first[1:], 0) - 1)
        text = of[run]
        owner = pa.array(np.asarray(rows)[text])
        yield pa.RecordBatch.from_arrays([*(batch[c].take(owner) for c in ("c1", "c2", "known")), pa.array((first - starts[text]).astype(np.int32)), pa.array((last - starts[text]).astype(np.int32)), *_hashed(code, first, last + length)], ["c1", "c2", "known", "a", "b", "h1", "h2"])


def _in_two_texts(df: DataFrame, keys: list[str], name: str, first: Column | None = None) -> tuple[DataFrame, DataFrame | None, str]:
    """(keys that stand in two different texts, or in a row that is known to be shared, those of them that are hot, as salted_join takes them, path): one aggregation gives all. first: its smallest value of each key comes too."""
    extra = {} if first is None else {"first": F.min(first)}
    counted = df.groupBy(*keys).agg(F.min("c1").alias("low"), F.max("c1").alias("high"), F.max("known").alias("known"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()])
    counted, path = written(counted.where("known or low < high").select(*keys, "n", *extra), name)
    floor = max(HOT_ROWS, int(HOT_SHARE * df.count()))
    hot = counted.where(F.col("n") > floor).select(*keys, F.ceil(F.col("n") / floor).cast("int").alias("__salts"))
    return counted.select(*keys, *extra), None if hot.isEmpty() else hot, path


TEXT = ["c1", "c2"]
PIECES = "c1 bigint, c2 bigint, known boolean, a int, b int, h1 bigint, h2 bigint"


def _listed(runs: DataFrame) -> DataFrame:
    """The runs of windows of each text as one list, which is no longer than the text."""
    return runs.groupBy(*TEXT).agg(F.collect_list(F.struct("a", "b")).alias("at"))


def shared_spans(docs: DataFrame, id_col: str, text: str, length: int = 160) -> DataFrame:
    """(id, start, end, chars): the longest stretches of each text covered by strings of `length` that stand in another record; chars is the text's size."""
    spark = docs.sparkSession
    used: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept, path = written(df, name)
        used.append(path)
        return kept

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null").where(F.length("text") >= length)
    rows = rows.withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(length), "text")})
    id_type = rows.schema["doc"].dataType.simpleString()
    classes = rows.groupBy(*TEXT).agg(F.min("doc").alias("rep"), F.max("doc").alias("last"), F.max(F.length("text")).alias("chars"))
    classes = keep(classes.withColumn("copied", F.col("rep") < F.col("last")).drop("last"), "classes")
    # round 1: landmarks in two different texts, and the stretches that runs of them make
    marks, marks_path = written(spread_out(rows).mapInArrow(lambda it: _emit_landmarks(it, length), f"c1 bigint, c2 bigint, doc {id_type}, k int, name bigint, a int, b int"), "landmarks")
    two, hot, two_path = _in_two_texts(marks.where("name is not null").withColumn("known", F.lit(False)), ["name"], "named")
    # one copy of each text goes on
    one = classes.select(*TEXT, F.col("rep").alias("doc"))
    held = salted_join(marks.where("name is not null"), two, ["name"], F.col("c1"), hot=hot).drop("name").join(one, [*TEXT, "doc"], "left_semi")
    by = Window.partitionBy(*TEXT).orderBy("k")
    run = F.sum((F.coalesce(F.col("k") - F.lag("k").over(by), F.lit(2)) > 1).cast("int")).over(by)
    runs = held.withColumn("run", run).groupBy(*TEXT, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <= b").drop("run")
    gaps = marks.where("name is null").join(one, [*TEXT, "doc"], "left_semi").select(*TEXT, "a", "b")
    stretches = keep(_listed(runs.unionByName(gaps)), "stretches")
    discard(spark, marks_path, two_path)
    few = stretches.count() <= BROADCAST_ROWS
    texts = keep(rows.select(*TEXT, "text", F.lit(False).alias("known")).join(F.broadcast(stretches) if few else stretches, TEXT).dropDuplicates(TEXT), "texts")
    # round 2: pieces of the stretches by their characters
    pieces = keep(texts.mapInArrow(lambda it: _emit_pieces(it, length, True), PIECES), "pieces")
    whole, hot, path = _in_two_texts(pieces, ["h1", "h2"], "whole", F.struct(*TEXT, "a", "b"))
    used.append(path)
    settled = keep(salted_join(pieces, whole.select("h1", "h2", F.lit(True).alias("shared")), ["h1", "h2"], F.col("c1"), "left", hot).select(*TEXT, "a", "b", "shared"), "settled")
    # round 3: what is left, window by window, against one copy of each piece that is shared as a whole
    ends = _listed(settled.where("shared is null")).withColumn("known", F.lit(False)).unionByName(_listed(whole.select("first.*")).withColumn("known", F.lit(True)))
    windows = keep(texts.drop("at", "known").join(ends, TEXT).mapInArrow(lambda it: _emit_pieces(it, length, False), PIECES), "windows")
    both, hot, path = _in_two_texts(windows, ["h1", "h2"], "both")
    used.append(path)
    found = salted_join(windows.where("not known"), both, ["h1", "h2"], F.col("c1"), hot=hot).select(*TEXT, "a", "b").unionByName(settled.where("shared").select(*TEXT, "a", "b"))
    by = Window.partitionBy(*TEXT).orderBy("a")
    far = F.coalesce(F.col("a") > F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)) + length, F.lit(True))
    spans = found.withColumn("new", far.cast("int")).withColumn("k", F.sum("new").over(by)).groupBy(*TEXT, "k").agg(F.min("a").alias("start"), (F.max("b") + length).alias("end")).drop("k")
    own = spans.join(classes.where("not copied"), TEXT).select(F.col("rep").alias("doc"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), "chars")
    copied = salted_join(rows.select("doc", *TEXT), classes.where("copied").select(*TEXT, "chars"), TEXT, F.col("doc")).select("doc", F.lit(0).cast("bigint").alias("start"), F.col("chars").cast("bigint").alias("end"), "chars").distinct()
    result, _ = written(own.unionByName(copied).withColumnRenamed("doc", id_col), "spans")
    discard(spark, *used)
    return result
