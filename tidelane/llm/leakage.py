"""Evaluation passages inside training texts: latent semantic retrieval, then exact checks.

Texts are coded as words once. Passages of `fit` words, cut side by side, make a TF-IDF matrix (words hashed to FEATURES,
document frequencies over the whole corpus) that goes through a distributed randomised SVD: its range is found by
A'(A Omega) with OVER more columns than the rank, then A'(A Q) is projected on that range and the small matrix
solved for the leading singular directions. Each task sends its share, FEATURES x (rank + OVER) numbers whatever its
input.

Candidates are pairs of passages, of a document every few words and of the items at every word or second word, whose cosine in that
space reaches least_cosine. They come through an index: the items' passages are clustered there (spherical k-means), and
a document's passage is held against those of the nearest cluster and of all whose centres' cosine is at most `margin` less. Pairs are checked at once in the
same task; no candidate list is written, and there is no cap on candidates. The index is the one approximate step: a
pair is missed if no passage of the stretch finds its counterpart's cluster. README states the recall.

Check for verbatim leaks: passages are shorter than min_words, so that a leak holds whole ones. Candidates that
lie against each other word by word, but for a few words, give an alignment, and along it the longest stretch of
min_words or more with at most one word in ten exchanged counts. Check for paraphrases: the longest common subsequence
of the item's passage and the document's, with a stride of words more on either side, and the share of the item's answer
words (words with digits) that the document's holds.

Items are a stated query set: they go to the tasks in blocks of BLOCK items, each a pass over the coded corpus.

Words are split at white space and compared case-folded and without anything but letters and digits.

Defined results: null ids or texts take no part; texts of no words match nothing; an item under min_words words can't
leak verbatim; for paraphrases an item or document shorter than a passage is one passage; equal documents are each
reported; a document is one row for each item; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.runtime import spread_out, written

FEATURES = 1 << 15
#: Features to a row of the matrices that tasks send, and columns beyond the rank in the search for the range.
ROWS, OVER = 512, 8
BLOCK = 2_000
#: Numbers that words are marked by, to bound how many two passages have in common: for all pairs, and for those left.
MARKS, FINE = 128, 1024
#: Words handled at once.
SPAN = 60_000
_CUT = re.compile(r"[\W_]+")


def word_codes(text: str, kept: dict[str, int]) -> np.ndarray:
    """32-bit codes of a text's words; kept caches them by raw word."""
    if len(kept) > 500_000:
        kept.clear()
    raws = text.split()
    out = list(map(kept.get, raws))
    if None in out:
        for k, code in enumerate(out):
            if code is None:
                word = raws[k].casefold()
                if not word.isalnum():
                    word = _CUT.sub("", word)
                out[k] = kept[raws[k]] = 1 + xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % 0xFFFFFFFF if word else 0
    codes = np.array(out, np.uint32)
    return codes[codes != 0]


def coded(docs: DataFrame) -> DataFrame:
    """(doc, words): the words of every text as codes, written once."""

    def code(batches):
        kept: dict[str, int] = {}
        for batch in batches:
            rows = [word_codes(t, kept).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(rows, pa.binary())], ["doc", "words"])

    rows = spread_out(docs.select("doc", "text").where("doc is not null and text is not null"))
    return written(rows.mapInArrow(code, f"doc {docs.schema['doc'].dataType.simpleString()}, words binary"), "coded")[0]


class Words:
    """Several texts' words in one array."""

    def __init__(self, texts: list[np.ndarray]):
        self.all = np.concatenate([*texts, np.empty(0, np.uint32)])
        self.offset = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)

    @staticmethod
    def of(batch) -> Words:
        return Words([np.frombuffer(w.as_buffer(), np.uint32) for w in batch["words"]])

    def passages(self, window: int, stride: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, behind) of passages at every stride and at the end; texts below a window are one, or none unless short."""
        size = np.diff(self.offset)
        n = np.where(size >= window, (size - window + stride - 1) // stride + 1, (size > 0) & short)
        text = np.repeat(np.arange(len(size)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = self.offset[text] + np.minimum(k * stride, np.maximum(size[text] - window, 0))
        return text, first, np.minimum(first + window, self.offset[text + 1])


def _unit(z: np.ndarray) -> np.ndarray:
    return (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def latent(words: np.ndarray, first: np.ndarray, behind: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit vectors of passages in the latent space: sums of the table's rows. Passages lie in rising order."""
    if not len(first):
        return np.zeros((0, table.shape[1]), np.float32)
    a = first[0]
    cum = np.zeros((behind.max() - a + 1, table.shape[1]))
    np.cumsum(table[words[a : a + len(cum) - 1] % FEATURES], axis=0, out=cum[1:])
    return _unit(cum[behind - a] - cum[first - a])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """IDF of every hashed word over all documents of coded(), zero for those in none. FEATURES numbers come to the driver."""

    def count(batches):
        n = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            w = Words.of(batch)
            text = np.repeat(np.arange(batch.num_rows), np.diff(w.offset))
            n[:FEATURES] += np.bincount(np.unique(text * FEATURES + w.all % FEATURES) % FEATURES, minlength=FEATURES)
            n[FEATURES] += batch.num_rows
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["f", "n"])

    df = np.zeros(FEATURES + 1)
    for f, n in docs.select("words").mapInArrow(count, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():
        df[f] = n
    return np.where(df[:FEATURES] > 0, np.log((df[FEATURES] + 1) / (df[:FEATURES] + 1)) + 0.1, 0.0)


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each passage, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else first, size) + np.arange(int(size.sum()))


class Sent:
    """A FEATURES x n matrix for the tasks, without the rows of zeros that words nobody uses have."""

    def __init__(self, x: np.ndarray):
        self.rows = np.flatnonzero(x.any(axis=1)).astype(np.int32)
        self.values = x[self.rows].astype(np.float32)

    def whole(self) -> np.ndarray:
        out = np.zeros((FEATURES, self.values.shape[1]), np.float32)
        out[self.rows] = self.values
        return out


def _gram(docs: DataFrame, idf: np.ndarray, x: np.ndarray, fit: int) -> np.ndarray:
    """A'(A x), A being the TF-IDF of all passages of `fit` words side by side."""
    spark = docs.sparkSession
    columns = x.shape[1]
    sent = spark.sparkContext.broadcast(Sent(idf[:, None] * x))

    def share(batches):
        table = sent.value.whole()
        total = np.zeros((FEATURES, columns), np.float32)
        for batch in batches:
            w = Words.of(batch)
            if not len(w.all):
                continue
            new = np.zeros(len(w.all), bool)
            new[w.passages(fit, fit, True)[1]] = True
            f = (w.all % FEATURES).astype(np.int64)
            for a in range(0, len(f), SPAN):
                part = f[a : a + SPAN]
                head = np.flatnonzero(new[a : a + SPAN])
                head = head if len(head) and head[0] == 0 else np.concatenate([[0], head])
                z = np.add.reduceat(table[part], head, axis=0)
                of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(part))))
                order = np.argsort(part, kind="stable")
                f_head = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0]))
                total[part[order][f_head]] += np.add.reduceat(z[of[order]], f_head, axis=0)
        rows = [(k, total[k * ROWS : (k + 1) * ROWS].tobytes()) for k in range(FEATURES // ROWS) if total[k * ROWS : (k + 1) * ROWS].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["k", "m"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch["k"].to_pylist(), batch["m"]):
                sums[k] = sums.get(k, 0) + np.frombuffer(m.as_buffer(), np.float32).reshape(ROWS, columns).astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["k", "m"])

    y = np.zeros((FEATURES, columns))
    for k, m in docs.select("words").mapInArrow(share, "k bigint, m binary").repartition("k").mapInArrow(add, "k bigint, m binary").collect():
        y[k * ROWS : (k + 1) * ROWS] = np.frombuffer(m, float).reshape(ROWS, columns)
    sent.destroy()
    return idf[:, None] * y


def singular_directions(docs: DataFrame, idf: np.ndarray, rank: int, fit: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as FEATURES x rank) of the TF-IDF passages, by randomised SVD."""
    q, _ = np.linalg.qr(_gram(docs, idf, np.random.default_rng(seed).standard_normal((FEATURES, rank + OVER)), fit))
    inner = q.T @ _gram(docs, idf, q, fit)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return np.sqrt(np.maximum(values[::-1][:rank], 0)), q @ turn[:, ::-1][:, :rank]


class ItemIndex:
    """One block of items: their passages, in clusters of the latent space."""

    def __init__(self, ids: list, texts: list[str], table: np.ndarray, window: int, stride: int, short: bool, seed: int = 5):
        kept: dict[str, int] = {}
        self.ids = ids
        self.words = Words([word_codes(t, kept) for t in texts])
        self.answers = frozenset(code for raw, code in kept.items() if code and any(c.isdigit() for c in raw))
        self.item, self.first, self.behind = self.words.passages(window, stride, short)
        z = latent(self.words.all, self.first, self.behind, table)
        # as many clusters as cost a search the same as the passages of a few of them
        clusters = max(1, min(len(z), int(2 * np.sqrt(len(z)))))
        self.centre = z[np.sort(np.random.default_rng(seed).choice(len(z), clusters, replace=False))] if len(z) else z
        nearest = lambda: np.concatenate([np.argmax(z[a : a + 8192] @ self.centre.T, axis=1) for a in range(0, len(z), 8192)] + [np.empty(0, int)])
        for _ in range(5):
            of = nearest()
            order = np.argsort(of, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0])) if len(z) else order
            if len(z):
                self.centre[of[order][head]] = _unit(np.add.reduceat(z[order], head, axis=0))
        of = nearest().astype(int)
        order = np.argsort(of, kind="stable")
        self.item, self.first, self.behind = (v[order].astype(np.int32) for v in (self.item, self.first, self.behind))
        self.z = z[order].astype(np.float16)  # half the size to send, and good to a thousandth
        self.bounds = np.searchsorted(of[order], np.arange(len(self.centre) + 1))

    def marks(self) -> np.ndarray:
        """How many words of each passage fall on each of MARKS numbers."""
        size = self.behind - self.first
        out = np.zeros((len(size), MARKS), np.float32)
        np.add.at(out, (np.repeat(np.arange(len(size)), size), self.words.all[_places(self.first, size)] % MARKS), 1)
        return out

    def near(self, z: np.ndarray, of_items: np.ndarray, margin: float, least: float, held: tuple | None = None):
        """(row of z, passage, cosine) of the pairs that reach the cosine, among the passages of each row's nearest cluster and of those whose centres are at most `margin` less close.

        held: (marks of the rows' words as 0 or 1, marks() of the passages, words each passage needs): a bound on the words in common.
        """
        cos = self.centre @ z.T
        of, row = np.nonzero(cos >= cos.max(axis=0) - margin)
        head = np.flatnonzero(np.concatenate([[True], np.diff(of) > 0])) if len(of) else of
        for a, b in zip(head, np.append(head[1:], len(of))):
            low, high = self.bounds[of[a]], self.bounds[of[a] + 1]
            c = z[row[a:b]] @ of_items[low:high].T
            ok = c >= least
            if held is not None and ok.any():
                ok &= held[0][row[a:b]] @ held[1][low:high].T >= held[2][low:high]
            hit = np.flatnonzero(ok.ravel())
            if len(hit):
                r, m = np.divmod(hit, high - low)
                yield row[a:b][r], low + m, c.ravel()[hit]


def longest_stretch(a: np.ndarray, b: np.ndarray, shift: int, min_words: int, exchanged: float) -> tuple[int, int]:
    """(words, first place in a) of the longest stretch of a against b (place in b = place in a - shift) with at most the given share exchanged; (0, 0) without one."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < min_words:
        return 0, 0
    same = a[lo:hi] == b[lo - shift : hi - shift]
    s = np.concatenate([[0.0], np.cumsum(np.where(same, exchanged, exchanged - 1.0))])
    low = np.minimum.accumulate(s)
    # for each end the earliest start at least as low: low falls, so search in it from behind
    start = np.searchsorted(-low, -(s + 1e-9), side="left")
    size = np.arange(len(s)) - start
    k = int(np.argmax(size))
    return (int(size[k]), int(start[k]) + lo) if size[k] >= min_words else (0, 0)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 25, exchanged: float = 0.1, window: int = 18, stride: int = 4, rank: int = 64, least_cosine: float = 0.8, margin: float = 0.2, fit: int = 32) -> DataFrame:
    """(doc, item, words, first_word, cosine): documents that hold a stretch of an item. docs: doc, text; items: item, text."""
    return _search(docs, items, _Verbatim(min_words, exchanged, window), window, stride, rank, least_cosine, margin, fit)


def paraphrases(docs: DataFrame, items: DataFrame, window: int = 32, stride: int = 8, rank: int = 64, least_cosine: float = 0.65, margin: float = 0.2, fit: int = 32, least_common: float = 0.7, least_answer: float = 0.5) -> DataFrame:
    """(doc, item, common, answers, cosine): documents with a passage close to one of an item; common is the share of its words in the longest common subsequence, answers that of its words with digits."""
    return _search(docs, items, _Reworded(least_common, least_answer, stride), window, stride, rank, least_cosine, margin, fit)


def _search(docs, items, check, window, stride, rank, least_cosine, margin, fit):
    spark = docs.sparkSession
    docs = coded(docs)
    idf = inverse_frequency(docs)
    table = (idf[:, None] * singular_directions(docs, idf, rank, fit)[1]).astype(np.float32)
    sent = spark.sparkContext.broadcast(Sent(table))
    d, i = docs.schema["doc"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"doc {d}, item {i}, {check.columns}"
    out, block = None, []

    def search():
        kept_index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in block], [r[1] for r in block], table, window, check.item_stride, check.short))
        return docs.mapInArrow(lambda it: _candidates(it, sent.value, kept_index.value, window, stride, least_cosine, margin, check, schema), schema)

    for row in items.where("item is not null and text is not null").select("item", "text").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            part = search()
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = search()
        out = part if out is None else out.unionByName(part)
    return out


def _candidates(batches, table, index: ItemIndex, window, stride, least_cosine, margin, check, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    if not len(index.z):
        return
    table, z_items, bound = table.whole(), index.z.astype(np.float32), check.bound(index)
    for batch in batches:
        words = Words.of(batch)
        text, first, behind = words.passages(window, stride, check.short)
        found: list[tuple] = []
        at = 0
        while at < len(first):
            end = max(at + 1, int(np.searchsorted(first, first[at] + SPAN)))
            z = latent(words.all, first[at:end], behind[at:end], table)
            held = bound and (check.marked(words, text[at:end], first[at:end], behind[at:end]), *bound)
            for row, passage, cosine in index.near(z, z_items, margin, least_cosine, held):
                kept = check.keep(words, first[at:end][row], behind[at:end][row], text[at:end][row], index, passage)
                if len(kept[0]):
                    pick = kept[0]
                    found.append((text[at:end][row[pick]], index.item[passage[pick]], cosine[pick], *kept[1:]))
            at = end
        if found:
            columns = check.rows(words, index, *(np.concatenate(c) for c in zip(*found)))
            if len(columns[0]):
                doc = batch["doc"].take(pa.array(columns[0]))
                item = pa.array([index.ids[k] for k in columns[1].tolist()])
                yield pa.RecordBatch.from_arrays([doc, item, *(pa.array(c) for c in columns[2:])], names)


class _Verbatim:
    """Alignments word by word, and the longest stretch along each."""

    columns, short, item_stride = "words bigint, first_word bigint, cosine double", False, 1
    #: Words that may differ in a passage. In a stretch with one in ten exchanged, some passage has no more.
    DIFFER = 3

    def __init__(self, min_words: int, exchanged: float, window: int):
        self.min_words, self.exchanged, self.window = min_words, exchanged, window

    def bound(self, index: ItemIndex) -> None:
        return None

    def keep(self, words: Words, first, behind, text, index: ItemIndex, passage):
        """Places of the pairs that lie against each other, and how far the document's place is ahead of the item's."""
        a, b = first, index.first[passage]
        open_, differ = np.arange(len(a)), np.zeros(len(a), np.int8)
        for k in range(self.window):
            differ += words.all[a + k] != index.words.all[b + k]
            if k >= self.DIFFER:
                on = differ <= self.DIFFER
                open_, a, b, differ = open_[on], a[on], b[on], differ[on]
                if not len(open_):
                    break
        text, item = text[open_], index.item[passage[open_]]
        return open_, (a - words.offset[text]) - (b - index.words.offset[item])

    def rows(self, words: Words, index: ItemIndex, text, item, cosine, shift):
        order = np.lexsort((-cosine, shift, item, text))
        text, item, cosine, shift = text[order], item[order], cosine[order], shift[order]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0)]))
        best: dict[tuple[int, int], tuple] = {}
        for k in head.tolist():
            t, i = int(text[k]), int(item[k])
            a, b = words.all[words.offset[t] : words.offset[t + 1]], index.words.all[index.words.offset[i] : index.words.offset[i + 1]]
            n, at = longest_stretch(a, b, int(shift[k]), self.min_words, self.exchanged)
            if n > best.get((t, i), (0,))[0]:
                best[t, i] = (n, at, float(cosine[k]))
        pairs = np.array(list(best), np.int64).reshape(-1, 2)
        values = list(best.values())
        return pairs[:, 0], pairs[:, 1], np.array([v[0] for v in values], np.int64), np.array([v[1] for v in values], np.int64), np.array([v[2] for v in values])


class _Reworded:
    """Longest common subsequence of the two passages, and the answer words."""

    columns, short, item_stride = "common double, answers double, cosine double", True, 2

    def __init__(self, least_common: float, least_answer: float, margin: int):
        self.least_common, self.least_answer, self.margin = least_common, least_answer, margin

    def bound(self, index: ItemIndex) -> tuple:
        return index.marks(), np.ceil(self.least_common * (index.behind - index.first) - 1e-9).astype(np.float32)

    def _around(self, words: Words, text, first, behind):
        return np.maximum(words.offset[text], first - self.margin), np.minimum(words.offset[text + 1], behind + self.margin)

    def marked(self, words: Words, text, first, behind) -> np.ndarray:
        a, b = self._around(words, text, first, behind)
        out = np.zeros((len(a), MARKS), np.float32)
        out[np.repeat(np.arange(len(a)), b - a), words.all[_places(a, b - a)] % MARKS] = 1
        return out

    def keep(self, words: Words, first, behind, text, index: ItemIndex, passage):
        """Places of the pairs that qualify, their common share and share of answers. Words held bound the subsequence before it is computed: by finer marks, then exactly."""
        out, common, answers = [], [], []
        low, high = self._around(words, text, first, behind)
        head, of = np.unique(low, return_index=True, return_inverse=True)[1:]
        seen = np.zeros((len(head), FINE), bool)
        seen[np.repeat(np.arange(len(head)), (high - low)[head]), words.all[_places(low[head], (high - low)[head])] % FINE] = True
        size = index.behind[passage] - index.first[passage]
        owner = np.repeat(np.arange(len(passage)), size)
        held = np.bincount(owner, seen[of[owner], index.words.all[_places(index.first[passage], size)] % FINE], len(passage))
        for k in np.flatnonzero(held >= self.least_common * size).tolist():
            mine, theirs = words.all[low[k] : high[k]], index.words.all[index.first[passage[k]] : index.behind[passage[k]]]
            have, said = set(mine.tolist()), theirs.tolist()
            if sum(x in have for x in said) < self.least_common * len(said):
                continue
            asked = [x for x in said if x in index.answers]
            share = sum(x in have for x in asked) / len(asked) if asked else 1.0
            if share < self.least_answer:
                continue
            c = common_subsequence(theirs, mine) / len(said)
            if c >= self.least_common:
                out.append(k)
                common.append(c)
                answers.append(share)
        return np.array(out, np.int64), np.array(common), np.array(answers)

    def rows(self, words: Words, index: ItemIndex, text, item, cosine, common, answers):
        order = np.lexsort((-answers, -common, item, text))
        head = order[np.concatenate([[True], (np.diff(text[order]) != 0) | (np.diff(item[order]) != 0)])]
        return text[head], item[head], np.round(common[head], 6), np.round(answers[head], 6), cosine[head].astype(float)
