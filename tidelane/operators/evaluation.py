"""Evaluation of classifiers and regressors, calibration, group-wise splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.bins import hash32

from tidelane.functions.compat import safe_div


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y, yhat, n) for every pair that occurs; null labels left out."""
    return df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))


def metrics(df: DataFrame, y: str, yhat: str, positive) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 and Cohen's kappa for one class."""
    a, p = F.col(y) == positive, F.col(yhat) == positive
    c = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    n, tp, fp, fn, tn = (F.col(k) for k in ("n", "tp", "fp", "fn", "tn"))
    po = safe_div(tp + tn, n)
    pe = safe_div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return c.select("n", po.alias("accuracy"), safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_div(po - pe, 1 - pe).alias("kappa"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row, auc: the chance that a positive outranks a negative, ties half. Scores are counted first, so the ordered window runs over distinct scores."""
    d = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    return d.agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def regression(df: DataFrame, y: str, yhat: str, weight: Column | None = None) -> DataFrame:
    """One row: r2, rmse, weighted rmse."""
    w = F.lit(1.0) if weight is None else weight
    e2 = F.pow(F.col(y) - F.col(yhat), 2)
    g = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(F.sum(e2).alias("sse"), F.var_pop(y).alias("v"), F.count(F.lit(1)).alias("n"), F.sum(w * e2).alias("wsse"), F.sum(w).alias("w"))
    return g.select((1 - safe_div(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), F.sqrt(F.col("wsse") / F.col("w")).alias("weighted_rmse"))


def residual_outliers(df: DataFrame, y: str, yhat: str, sigmas: float = 3.0) -> DataFrame:
    """Rows whose residual lies over `sigmas` deviations from the mean residual."""
    r = F.col(y) - F.col(yhat)
    s = df.agg(F.avg(r).alias("__m"), F.stddev_samp(r).alias("__s"))
    return df.join(F.broadcast(s)).where(F.abs(r - F.col("__m")) > sigmas * F.col("__s")).drop("__m", "__s")


def reliability(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, mean_score, observed, n): mean score and share of positives in equal bins of the score."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def calibration_table(curve: DataFrame) -> DataFrame:
    """(hundredth, calibrated) for 0 to 100: the reliability curve interpolated, flat beyond its ends."""
    c = curve.select("mean_score", "observed", F.lead(F.struct("mean_score", "observed")).over(Window.orderBy("mean_score")).alias("n"))
    ends = curve.agg(F.min(F.struct("mean_score", "observed")).alias("first"), F.max(F.struct("mean_score", "observed")).alias("last"))
    t = curve.sparkSession.range(0, 101).withColumnRenamed("id", "hundredth").withColumn("x", F.col("hundredth") / 100.0)
    t = t.join(F.broadcast(c.where("n is not null")), (F.col("x") >= F.col("mean_score")) & (F.col("x") < F.col("n.mean_score")), "left").join(F.broadcast(ends))
    line = F.col("observed") + (F.col("n.observed") - F.col("observed")) * (F.col("x") - F.col("mean_score")) / (F.col("n.mean_score") - F.col("mean_score"))
    flat = F.when(F.col("x") < F.col("first.mean_score"), F.col("first.observed")).when(F.col("x") >= F.col("last.mean_score"), F.col("last.observed"))
    return t.select("hundredth", F.coalesce(flat, line).alias("calibrated"))


def calibrate(df: DataFrame, score: str, table: DataFrame) -> DataFrame:
    """df with calibrated, looked up by the score in whole hundredths."""
    return df.withColumn("hundredth", F.round(F.col(score) * 100).cast("bigint")).join(F.broadcast(table), "hundredth", "left").drop("hundredth")


def fold(key: Column, folds: int, seed: int = 0) -> Column:
    """Fold of a group key by hash: all rows of a key share one."""
    return (hash32(key, seed) % folds).cast("int")


def masked_squared_error(y: Column, yhat: Column) -> Column:
    """Squared error, nothing where the truth is missing or not positive."""
    return F.when(y > 0, F.pow(y - yhat, 2)).otherwise(0.0)
