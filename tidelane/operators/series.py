"""Time series: rolling windows over sparse days, dense grids, gap interpolation, trends, spikes and bootstrap."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.runtime import BROADCAST_ROWS


def rolling_expand(df: DataFrame, date: str, back: int, forward: int, name: str = "rolling_date") -> DataFrame:
    """df with a row for each day from `back` before to `forward` after: a rolling window becomes an equality, not a theta join."""
    d = F.col(date).cast("date")
    return df.withColumn(name, F.explode(F.sequence(F.date_sub(d, back), F.date_add(d, forward))))


def smoothed_periods(df: DataFrame, date: str, start: dt.date, step: int = 24, reach: int = 48, name: str = "period") -> DataFrame:
    """df with a row for each period start (every `step` days from `start`) at most `reach` days away."""
    days = F.datediff(F.col(date).cast("date"), F.lit(start))
    low, high = F.ceil((days - reach) / step), F.floor((days + reach) / step)
    return df.withColumn("__n", F.explode(F.sequence(low.cast("int"), high.cast("int")))).withColumn(name, F.date_add(F.lit(start), F.col("__n") * step)).drop("__n")


def densify(facts: DataFrame, cells: DataFrame, periods: DataFrame, keys: list[str], period: str, values: list[str]) -> DataFrame:
    """Every cell in every period; missing facts count zero, and is_missing says so. The periods are a calendar, whose size is checked: each cell gets them as one list."""
    calendar = [r[0] for r in periods.select(period).distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(calendar) > BROADCAST_ROWS:
        raise ValueError(f"over {BROADCAST_ROWS} periods; densify in parts")
    kind = periods.schema[period].dataType
    grid = cells.select(*keys).distinct().withColumn(period, F.explode(F.array(*[F.lit(x).cast(kind) for x in sorted(x for x in calendar if x is not None)]).cast(f"array<{kind.simpleString()}>")))
    out = grid.join(facts.withColumn("__seen", F.lit(True)), [*keys, period], "left")
    return out.withColumns({v: F.coalesce(v, F.lit(0)) for v in values}).withColumn("is_missing", F.col("__seen").isNull()).drop("__seen")


def interpolate_gaps(df: DataFrame, keys: list[str], t: str, value: str, observed: Column) -> DataFrame:
    """df with <value>_i: linear between observed neighbours, the nearest one at the ends; null in series that are nowhere above zero unless observed.

    A series is one cell's calendar, so its window is bounded by the number of periods.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    back, ahead, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    at = F.when(observed & F.col(value).isNotNull(), F.struct(F.datediff(F.col(t).cast("date"), F.lit(dt.date(1970, 1, 1))).alias("x"), F.col(value).cast("double").alias("y")))
    x = F.datediff(F.col(t).cast("date"), F.lit(dt.date(1970, 1, 1)))
    z = df.withColumn("__o", at)
    z = z.withColumns({"__p": F.last("__o", True).over(back), "__q": F.last("__o", True).over(ahead), "__m": F.max("__o.y").over(whole)})
    line = F.col("__p.y") + (F.col("__q.y") - F.col("__p.y")) * (x - F.col("__p.x")) / F.nullif(F.col("__q.x") - F.col("__p.x"), F.lit(0))
    filled = F.when(F.col("__o").isNotNull(), F.col("__o.y")).when(F.col("__m") > 0, F.coalesce(line, F.col("__p.y"), F.col("__q.y")))
    return z.withColumn(f"{value}_i", filled).drop("__o", "__p", "__q", "__m")


def rolling_stat(keys: list[str], t: str, back: int, forward: int, stat) -> Column:
    """stat(window) over rows from `back` before to `forward` after; null unless the frame is full."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-back, forward)
    return F.when(F.count(F.lit(1)).over(w) == back + forward + 1, stat(w))


def median_of_three(c: str):
    """For rolling_stat(): the middle of a full frame of three."""
    return lambda w: F.get(F.array_sort(F.collect_list(c).over(w)), F.lit(1))


def hodrick_prescott(y: np.ndarray, lam: float) -> np.ndarray:
    """Trend that balances fit and squared second differences: a pentadiagonal system, solved in linear time."""
    n = len(y)
    if n < 3:
        return y.astype(float).copy()
    d, e, f = np.ones(n), np.zeros(n), np.zeros(n)  # diagonal and the two above it
    for a, b, c, i in ((1, -2, 1, k) for k in range(n - 2)):
        d[i] += lam * a * a
        d[i + 1] += lam * b * b
        d[i + 2] += lam * c * c
        e[i] += lam * a * b
        e[i + 1] += lam * b * c
        f[i] += lam * a * c
    mu, r1, r2 = np.zeros(n), np.zeros(n), np.zeros(n)  # factors of an LDL' decomposition
    z = np.zeros(n)
    for i in range(n):
        mu[i] = d[i] - (mu[i - 1] * r1[i - 1] ** 2 if i > 0 else 0) - (mu[i - 2] * r2[i - 2] ** 2 if i > 1 else 0)
        r1[i] = (e[i] - (mu[i - 1] * r1[i - 1] * r2[i - 1] if i > 0 else 0)) / mu[i]
        r2[i] = f[i] / mu[i]
        z[i] = y[i] - (r1[i - 1] * z[i - 1] if i > 0 else 0) - (r2[i - 2] * z[i - 2] if i > 1 else 0)
    x = z / mu
    for i in range(n - 2, -1, -1):
        x[i] -= r1[i] * x[i + 1] + (r2[i] * x[i + 2] if i + 2 < n else 0)
    return x


def trend_and_cycle(df: DataFrame, key: str, t: str, value: str, lam: float) -> DataFrame:
    """(key, t, value, trend, cycle) for each series; a series is one calendar, so a task holds little."""
    schema = f"{key} string, {t} date, {value} double, trend double, cycle double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        pdf["trend"] = hodrick_prescott(pdf[value].to_numpy(float), lam)
        pdf["cycle"] = pdf[value] - pdf["trend"]
        return pdf

    return df.select(F.col(key).cast("string").alias(key), F.col(t).cast("date").alias(t), F.col(value).cast("double").alias(value)).dropna().groupBy(key).applyInPandas(solve, schema)


def despike(df: DataFrame, key: str, t: str, value: str, n_std: float = 3.0, rounds: int = 2, lam: float = 129_600.0) -> DataFrame:
    """(key, t, value, clean): points whose distance from the Hodrick-Prescott trend is over n_std deviations are replaced by interpolation (at the start by what follows), repeatedly."""
    schema = f"{key} string, {t} date, {value} double, clean double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf[value].astype(float).reset_index(drop=True)
        for _ in range(rounds):
            rest = y.to_numpy() - hodrick_prescott(y.to_numpy(), lam)
            y = y.mask(np.abs(rest) > n_std * rest.std()).interpolate().bfill()
        pdf["clean"] = y.to_numpy()
        return pdf

    return df.select(F.col(key).cast("string").alias(key), F.col(t).cast("date").alias(t), F.col(value).cast("double").alias(value)).dropna().groupBy(key).applyInPandas(solve, schema)


def stationary_block_length(y: np.ndarray) -> float:
    """Mean block length for a stationary bootstrap by the automatic rule of Politis and White (2004), as corrected in 2009."""
    n = len(y)
    z = y - y.mean()
    if n < 4 or not z.any():
        return 1.0
    near = max(5, int(np.sqrt(np.log10(n))))
    most_lag = int(np.ceil(np.sqrt(n))) + near
    cov = np.array([z[: n - k] @ z[k:] / n for k in range(min(n - 1, most_lag) + 1)])
    small = np.abs(cov[1:] / cov[0]) < 2 * np.sqrt(np.log10(n) / n)
    # the last lag before `near` small autocorrelations in a row
    runs = [m for m in range(len(small) - near + 1) if small[m : m + near].all()]
    m = runs[0] if runs else int(np.flatnonzero(~small)[-1]) + 1 if (~small).any() else 1
    width = min(2 * max(m, 1), len(cov) - 1)
    k = np.arange(-width, width + 1)
    window = np.clip(2 * (1 - np.abs(k) / width), 0, 1)
    g0, g1 = (window * cov[np.abs(k)]).sum(), (window * np.abs(k) * cov[np.abs(k)]).sum()
    length = (g1 * g1 / (g0 * g0)) ** (1 / 3) * n ** (1 / 3) if g0 else 1.0
    return float(np.clip(length, 1.0, np.ceil(min(3 * np.sqrt(n), n / 3))))


def stationary_means(y: np.ndarray, block: float, reps: int, rng: np.random.Generator) -> np.ndarray:
    """Means of `reps` resamples: a new block starts with chance 1/block, else the next value follows, round the end."""
    n = len(y)
    out = []
    place = np.arange(n)
    for k in range(0, reps, 1000):
        rows = min(1000, reps - k)
        new = rng.random((rows, n)) < 1.0 / block
        new[:, 0] = True
        head = np.maximum.accumulate(np.where(new, place, 0), axis=1)
        start = np.take_along_axis(rng.integers(0, n, (rows, n)), head, axis=1)
        out.append(y[(start + place - head) % n].mean(axis=1))
    return np.concatenate(out)


def block_bootstrap(df: DataFrame, key: str, t: str, value: str, split: dt.date, reps: int = 100_000, seed: int = 1) -> DataFrame:
    """(key, change, low, high, block): percent change of the mean after a date against the season's mean before it, with a 95 % interval.

    The season is the mean of each day of the year before the date. What differs from it, before and after, is drawn by a
    stationary block bootstrap whose block length is estimated from both sides. A series without values on both sides, or
    with a season of mean zero, gives no row; days of the year without a value before the date don't count.
    """
    schema = f"{key} string, change double, low double, high double, block double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        days = pd.to_datetime(pdf[t])
        leap = ((days.dt.month == 2) & (days.dt.day == 29)).to_numpy()
        pdf, days = pdf[~leap], days[~leap]
        of_year = (days.dt.month * 100 + days.dt.day).to_numpy()
        before = (pdf[t] < split).to_numpy()
        y = pdf[value].to_numpy(float)
        season = pd.Series(y[before]).groupby(of_year[before]).mean()
        rest = y - season.reindex(of_year).to_numpy()
        a, b = rest[before], rest[~before & ~np.isnan(rest)]
        if not len(a) or not len(b) or season.mean() == 0:
            return pd.DataFrame(columns=[key, "change", "low", "high", "block"])
        block = max(1.0, round(0.5 * (stationary_block_length(a) + stationary_block_length(b))))
        rng = np.random.default_rng([seed, *pdf[key].iloc[0].encode()])
        changes = 100 * (stationary_means(b, block, reps, rng) - stationary_means(a, block, reps, rng)) / season.mean()
        low, high = np.percentile(changes, [2.5, 97.5])
        return pd.DataFrame([(pdf[key].iloc[0], 100 * (b.mean() - a.mean()) / season.mean(), low, high, block)], columns=[key, "change", "low", "high", "block"])

    return df.select(F.col(key).cast("string").alias(key), F.col(t).cast("date").alias(t), F.col(value).cast("double").alias(value)).dropna().groupBy(key).applyInPandas(solve, schema)


def quadratic_trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, c0, c1, c2): least squares c0 + c1 x + c2 x^2 from sums, in one aggregation."""
    s = {f"s{k}": F.sum(F.pow(x, k)) for k in range(5)} | {f"t{k}": F.sum(F.col(y) * F.pow(x, k)) for k in range(3)}
    g = df.groupBy(*keys).agg(*[v.alias(k) for k, v in s.items()])
    m = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    t = [F.col(f"t{i}") for i in range(3)]

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    whole = F.nullif(det(m), F.lit(0.0))
    return g.select(*keys, *[(det([[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / whole).alias(f"c{k}") for k in range(3)])
