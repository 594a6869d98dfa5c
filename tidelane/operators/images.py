"""Image tiles as arrays: detection at a constant false alarm rate, composites, masks, preparation and inference.

A tile is a row with height, width and a flat array of values in row order. Kernels run over Arrow batches and see one
tile at a time; a scene is as many tiles as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: integers to a unit of backscatter.
SCALE = 1e4


def to_backscatter(db: Column, angle_deg: Column) -> Column:
    """Decibels to scaled power, corrected for the incidence angle."""
    return F.pow(F.lit(10.0), db / 10.0) * SCALE * F.sin(F.radians(angle_deg))


def box_sum(a: np.ndarray, half: int) -> np.ndarray:
    """Sum over the square of 2 half + 1 around each place, outside counting zero, by an integral image."""
    p = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=p[1:, 1:])
    r0, r1 = np.clip(np.arange(a.shape[0]) - half, 0, None), np.clip(np.arange(a.shape[0]) + half + 1, None, a.shape[0])
    c0, c1 = np.clip(np.arange(a.shape[1]) - half, 0, None), np.clip(np.arange(a.shape[1]) + half + 1, None, a.shape[1])
    return p[np.ix_(r1, c1)] - p[np.ix_(r0, c1)] - p[np.ix_(r1, c0)] + p[np.ix_(r0, c0)]


def bright(a: np.ndarray, inner: int, outer: int, k: float) -> np.ndarray:
    """Places k deviations or more above the mean of the ring between two squares."""
    ones = np.ones_like(a)
    ring = lambda x: box_sum(x, outer) - box_sum(x, inner)
    n = np.maximum(ring(ones), 1)
    mean = ring(a) / n
    sd = np.sqrt(np.maximum(ring(a * a) / n - mean * mean, 0))
    return (a >= mean + k * sd) & (sd > 0)


def dilate(m: np.ndarray, half: int) -> np.ndarray:
    return box_sum(m.astype(float), half) > 0.5


def regions(m: np.ndarray) -> np.ndarray:
    """Number of the 8-connected region of each place, 0 for none: labels spread until nothing changes."""
    lab = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    while True:
        p = np.pad(lab, 1)
        best = np.max([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(m, best, 0)
        if (new == lab).all():
            return lab
        lab = new


def _tile(row) -> np.ndarray:
    return np.asarray(row.vals, float).reshape(int(row.height), int(row.width))


def detect(tiles: DataFrame, inner: int = 1, outer: int = 3, k: float = 2.0, grow: int = 0) -> DataFrame:
    """(tile_id, row, col, pixels, peak): centres of the bright regions of each tile (tile_id, height, width, vals); null values count zero."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                a = np.nan_to_num(_tile(t))
                m = bright(a, inner, outer, k)
                lab = regions(dilate(m, grow) if grow else m)
                for r in np.unique(lab[lab > 0]):
                    y, x = np.nonzero(lab == r)
                    out.append((t.tile_id, float(y.mean()), float(x.mean()), len(y), float(a[y, x].max())))
            yield pd.DataFrame(out, columns=["tile_id", "row", "col", "pixels", "peak"])

    return tiles.select("tile_id", "height", "width", "vals").mapInPandas(run, f"tile_id {tiles.schema['tile_id'].dataType.simpleString()}, row double, col double, pixels bigint, peak double")


def median_composite(pixels: DataFrame, least: int) -> DataFrame:
    """(y, x, median, images): the median over images (rows y, x, v) of pixels that `least` images or more show."""
    g = pixels.where("v is not null").groupBy("y", "x").agg(F.percentile("v", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("images"))
    return g.where(F.col("images") >= least)


def outline(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y) along the pixel edges of a mask, the mask to their left; holes run the other way."""
    m = np.pad(mask, 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(m)):
        for dy, dx, a, b in ((-1, 0, (x + 1, y), (x, y)), (0, -1, (x, y), (x, y + 1)), (1, 0, (x, y + 1), (x + 1, y + 1)), (0, 1, (x + 1, y + 1), (x + 1, y))):
            if not m[y + dy, x + dx]:
                edges.setdefault((int(a[0]) - 1, int(a[1]) - 1), []).append((int(b[0]) - 1, int(b[1]) - 1))
    rings = []
    while edges:
        at = min(edges)
        ring = [at]
        while True:
            ends = edges[at]
            if len(ends) > 1 and len(ring) > 1:  # two pixels meet at a corner: stay with the one that is on the left
                back = (ring[-2][0] - at[0], ring[-2][1] - at[1])
                ends.sort(key=lambda e: back[0] * (e[1] - at[1]) - back[1] * (e[0] - at[0]))
            to = ends.pop(0)
            if not ends:
                del edges[at]
            at = to
            if at == ring[0]:
                break
            ring.append(at)
        corners = [p for a, p, b in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]]) if (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0])]
        rings.append([*corners, corners[0]])
    return rings


def footprint_mask(tiles: DataFrame, share: float = 0.01) -> DataFrame:
    """(tile_id, valid, geometry): the largest connected region of pixels above a low percentile, which border noise lies under, as WKT in pixel coordinates.

    vals may hold several bands, one tile after the other; a pixel counts where every band is above its percentile.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                bands = np.nan_to_num(np.asarray(t.vals, float), nan=-np.inf).reshape(-1, int(t.height), int(t.width))
                lab = regions(np.all([a > np.percentile(a, 100 * share) for a in bands], axis=0))
                names, sizes = np.unique(lab[lab > 0], return_counts=True)
                if len(names):
                    rings = outline(lab == names[np.argmax(sizes)])
                    text = ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings)
                    out.append((t.tile_id, int(sizes.max()), f"POLYGON ({text})"))
            yield pd.DataFrame(out, columns=["tile_id", "valid", "geometry"])

    return tiles.select("tile_id", "height", "width", "vals").mapInPandas(run, f"tile_id {tiles.schema['tile_id'].dataType.simpleString()}, valid bigint, geometry string")


def prepared(vals: Column, divider: float) -> Column:
    """Channel on a log scale: log1p of the positive part, divided."""
    return F.transform(vals, lambda v: F.log1p(F.greatest(v.cast("double"), F.lit(0.0))) / divider)


def cropped(vals: Column, width: int, margin: int, height: int) -> Column:
    """A flat tile without `margin` pixels on every side."""
    rows = F.sequence(F.lit(margin), F.lit(height - margin - 1))
    return F.flatten(F.transform(rows, lambda r: F.slice(vals, r * width + margin + 1, width - 2 * margin)))


def smoothed_labels(label: Column, classes: int, eps: float = 0.1) -> Column:
    """One-hot vector of a class number, moved towards uniform by eps."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0 - eps).otherwise(0.0) + eps / classes)


def evidence_scores(evidence: Column) -> Column:
    """Class scores e / sum(e + 1) of non-negative evidence."""
    total = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + e + 1.0)
    return F.transform(evidence, lambda e: e / total)


def scaled_sigmoid(x: Column, most: float) -> Column:
    return most / (1.0 + F.exp(-x))


def scaled_and_cropped(a: np.ndarray, scale: float) -> np.ndarray:
    """The tile enlarged (or shrunk) about its middle, at its old size: nearest pixel, zero outside."""
    h, w = a.shape
    y = np.floor((np.arange(h) + 0.5 - h / 2) / scale + h / 2).astype(int)
    x = np.floor((np.arange(w) + 0.5 - w / 2) / scale + w / 2).astype(int)
    inside = ((y >= 0) & (y < h))[:, None] & ((x >= 0) & (x < w))[None, :]
    return np.where(inside, a[np.clip(y, 0, h - 1)][:, np.clip(x, 0, w - 1)], 0.0)


def augmented(tiles: DataFrame, length: str | None = None, seed: int = 0, most_scale: float = 1.25) -> DataFrame:
    """Tiles flipped, transposed, rolled and scaled by draws that depend on a hash of tile_id alone; square tiles only are transposed. A length in the tile grows with its scale."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            pdf = pdf.copy()
            made, scales = [], []
            for t in pdf.itertuples():
                rng = np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(str(t.tile_id).encode(), digest_size=8).digest(), "big")])
                a = _tile(t)
                if rng.random() < 0.5:
                    a = a[::-1]
                if rng.random() < 0.5:
                    a = a[:, ::-1]
                if a.shape[0] == a.shape[1] and rng.random() < 0.5:
                    a = a.T
                a = np.roll(a, rng.integers(-2, 3, 2), axis=(0, 1))
                scales.append(most_scale ** rng.uniform(-1, 1))
                made.append(scaled_and_cropped(a, scales[-1]).ravel().tolist())
            pdf["vals"] = made
            pdf["length"] = pdf["length"] * scales
            yield pdf

    size = F.lit(None).cast("double") if length is None else F.col(length).cast("double")
    t = tiles.select("tile_id", "height", "width", F.col("vals").cast("array<double>").alias("vals"), size.alias("length"))
    return t.mapInPandas(run, t.schema)


def predicted(tiles: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], outputs: list[str], batch: int = 256) -> DataFrame:
    """(tile_id, outputs): a model over batches of tiles of one size. load() gives the model, once for each task; it always sees `batch` tiles, the last ones filled up with zeros."""

    def run(batches: Iterator[pd.DataFrame]):
        model = load()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                x = np.stack([_tile(t) for t in part.itertuples()])
                y = model(np.concatenate([x, np.zeros((batch - len(x), *x.shape[1:]))]))[: len(x)]
                yield pd.DataFrame({"tile_id": part["tile_id"].to_numpy(), **{k: np.asarray(y[:, j], float) for j, k in enumerate(outputs)}})

    kind = tiles.schema["tile_id"].dataType.simpleString()
    return tiles.select("tile_id", "height", "width", "vals").mapInPandas(run, ", ".join([f"tile_id {kind}", *(f"{k} double" for k in outputs)]))


def greedy_dedup(points: DataFrame, by: str, radius_m: float, order: str) -> DataFrame:
    """(id): per group of `by` points (id, lat, lon) as they were first seen by `order` (then id), dropping those within the radius of one kept. Groups are single images; cells sized by the radius find neighbours."""
    kind = points.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidelane.functions.geo import haversine_np

        pdf = pdf.sort_values([order, "id"])
        step = np.degrees(radius_m / 6_371_000.0)
        kept: dict[tuple[int, int], list[tuple[float, float]]] = {}
        ids = []
        for i, la, lo in zip(pdf["id"], pdf["lat"], pdf["lon"]):
            w = step / max(0.01, np.cos(np.radians(la)) * 0.99)
            y, x = int(la // step), int(lo // w)
            near = [p for a in (-1, 0, 1) for q in (-2, -1, 0, 1, 2) for p in kept.get((y + a, x + q), [])]
            if all(haversine_np(la, lo, p[0], p[1]) > radius_m for p in near):
                kept.setdefault((y, x), []).append((la, lo))
                ids.append(i)
        return pd.DataFrame({"id": ids})

    return points.select(by, "id", "lat", "lon", order).dropna().groupBy(by).applyInPandas(run, f"id {kind}")
