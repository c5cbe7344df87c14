"""Rolling one-step evaluation of forecasting methods, and backtests from many origins.

A row a series and week carries all that the methods need from its lookback: the past values, their moments, and the normal equations of an autoregression. The latter slide: products are summed up once along each
series, and a lookback's sums are those up to its last week less those up to the week before its first, so that a week adds a row and takes one off. Samples and their scores are arrays of a fixed number of draws
within the row, so beyond the one window over each series nothing is shuffled, whatever the number of methods and draws.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rng import normal, uniform
from tidemark.operators.stats import LEVELS

FREEDOM = 4  # of Student-t noise


def lookbacks(df: DataFrame, key: str, week: str, x: str, length: int, lags: int) -> DataFrame:
    """df(key, week, x) with past (up to ``length`` values before the week, the oldest first), n, mu, sd (null below two), recent (the last ``lags``, the newest first; null before there
    are so many) and sums: of the lookback's rows (count, lags, value, products of lags, products of lags with the value, squared value). Rows without a value are no part of a series.
    """
    w = Window.partitionBy(key).orderBy(week)
    lagged = F.array(*(F.lag(x, i).over(w) for i in range(1, lags + 1)))
    rows = df.filter(F.col(x).isNotNull()).select(key, week, x).withColumn("lags_", lagged)
    full, item = F.forall("lags_", lambda v: v.isNotNull()), lambda i: F.col("lags_")[i]
    y = F.col(x)
    products = [F.lit(1.0), *(item(i) for i in range(lags)), y, *(item(i) * item(j) for i in range(lags) for j in range(i, lags)), *(item(i) * y for i in range(lags)), y * y]
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("*", F.array(*(F.sum(F.when(full, p).otherwise(0.0)).over(so_far) for p in products)).alias("so_far_"))
    before, first = F.lag("so_far_", 1).over(w), F.lag("so_far_", length + 1).over(w)
    taken = F.when(first.isNull(), before).otherwise(F.zip_with(before, first, lambda a, b: a - b))
    frame = w.rowsBetween(-length, -1)
    got = sums.withColumn("past", F.collect_list(x).over(frame)).withColumn("mu", F.avg(x).over(frame)).withColumn("sd", F.stddev_samp(x).over(frame)).withColumn("sums", taken)
    return got.select(key, week, x, "past", F.size("past").alias("n"), "mu", "sd", F.when(full, F.col("lags_")).alias("recent"), "sums")


def autoregression(sums: Column, lags: int, ridge: float = 1e-6, most: float = 0.98) -> Column:
    """(intercept, coefficients, sd, radius) from a row's sums, ridge on the centred lags; shrunk until the companion's spectral radius is at most ``most``. Null with fewer rows than ``lags + 2``. All rows of a batch are solved together."""

    @F.pandas_udf("intercept double, coefficients array<double>, sd double, radius double")
    def solve(batch: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"intercept": np.nan, "coefficients": None, "sd": np.nan, "radius": np.nan}, index=range(len(batch)), dtype=object)
        ok = [i for i, s in enumerate(batch) if s is not None and s[0] > lags + 1.5]
        if not ok:
            return out.where(out.notna(), None)
        s = np.stack([np.asarray(batch.iloc[i], float) for i in ok])
        n, mx, my = s[:, 0], s[:, 1 : lags + 1] / s[:, :1], s[:, lags + 1] / s[:, 0]
        xx, at = np.zeros((len(s), lags, lags)), lags + 2
        for i in range(lags):
            for j in range(i, lags):
                xx[:, i, j] = xx[:, j, i] = s[:, at] - n * mx[:, i] * mx[:, j]
                at += 1
        xy, yy = s[:, at : at + lags] - n[:, None] * mx * my[:, None], s[:, -1] - n * my**2
        b = np.linalg.solve(xx + ridge * np.eye(lags), xy[:, :, None])[:, :, 0]
        companion = np.zeros((len(s), lags, lags))
        companion[:, 1:, :-1] = np.eye(lags - 1)
        for _ in range(60):
            companion[:, 0] = b
            radius = np.abs(np.linalg.eigvals(companion)).max(axis=1)
            if (radius <= most).all():
                break
            b = np.where((radius > most)[:, None], b * 0.95, b)
        left = yy - 2 * (b * xy).sum(axis=1) + np.einsum("ni,nij,nj->n", b, xx, b)
        sd = np.sqrt(np.maximum(left, 0.0) / n + 1e-8)
        for row, i in enumerate(ok):
            out.iloc[i] = [float(my[row] - mx[row] @ b[row]), b[row].tolist(), float(sd[row]), float(radius[row])]
        return out.where(out.notna(), None)

    return solve(sums)


def _draws(samples: int, one: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), one)


def methods(key: Sequence[Column], samples: int, seed: int = 52) -> dict[str, Column]:
    """For each method its samples of the next value, an array, from the columns of ``lookbacks`` and ``model``, the autoregression. Each draw has a counter of its own: the method, the key and its number."""
    noise = lambda name, k: normal(seed, name, *key, k)

    def student(k: Column) -> Column:
        chi2 = sum((F.pow(noise(f"t{i}", k), 2) for i in range(2, FREEDOM + 1)), F.pow(noise("t1", k), 2))
        return noise("t0", k) / F.sqrt(chi2 / FREEDOM) * math.sqrt((FREEDOM - 2) / FREEDOM)

    guess = F.col("model.intercept") + F.aggregate(F.zip_with("model.coefficients", "recent", lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    return {
        "zero_return": _draws(samples, lambda k: F.lit(0.0)),
        "block_bootstrap": _draws(samples, lambda k: F.get("past", F.floor(uniform(seed, "rows", *key, k) * F.col("n")).cast("int"))),
        "gaussian": _draws(samples, lambda k: F.col("mu") + F.col("sd") * noise("gauss", k)),
        "student_t": _draws(samples, lambda k: F.col("mu") + F.col("sd") * student(k)),
        "linear": _draws(samples, lambda k: guess + F.col("model.sd") * noise("linear", k)),
    }


def quantile_of(s: Column, p: float) -> Column:
    """Of a sorted array, interpolated."""
    at = (F.size(s) - 1) * F.lit(p)
    low = F.floor(at)
    a, b = F.get(s, low.cast("int")), F.get(s, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def scored(df: DataFrame, samples: str, actual: str) -> DataFrame:
    """``df`` with, of the array of samples: q (at LEVELS), percentile (the share at or below the actual value), crps, absolute_error of the median, and whether its direction was right."""
    s, y = F.col("sorted_"), F.col(actual)
    n = F.size(s).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    off = total(F.transform(s, lambda v: F.abs(v - y))) / n
    spread = total(F.transform(s, lambda v, i: (2 * i + 1 - n) * v)) / (n * n)
    got = df.withColumn("sorted_", F.array_sort(samples)).withColumn("q", F.array(*(quantile_of(s, p) for p in LEVELS)))
    middle = F.col("q")[LEVELS.index(0.5)]
    return got.select(
        *(c for c in df.columns if c != samples), "q", (F.size(F.filter(s, lambda v: v <= y)) / n).alias("percentile"), (off - spread).alias("crps"), F.abs(middle - y).alias("absolute_error"), (F.signum(middle) == F.signum(y)).alias("direction_correct")
    )


def rolling(df: DataFrame, key: str, week: str, x: str, start: str, length: int = 104, least: int = 52, lags: int = 1, samples: int = 100, ridge: float = 1e-6, seed: int = 52) -> DataFrame:
    """(key, week, actual, method, q, percentile, crps, absolute_error, direction_correct): each method's one-step forecasts of each week from ``start`` on that has ``least`` values in its lookback."""
    rows = lookbacks(df, key, week, x, length, lags).filter((F.col(week) >= F.lit(start).cast("date")) & (F.col("n") >= least)).withColumn("model", autoregression(F.col("sums"), lags, ridge))
    by = methods([F.col(key), F.date_format(week, "yyyy-MM-dd")], samples, seed)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), s.alias("samples")) for m, s in by.items())))
    long = rows.select(key, week, F.col(x).alias("actual"), each.alias("m")).select(key, week, "actual", "m.method", "m.samples").filter(F.get("samples", F.lit(0)).isNotNull())
    return scored(long, "samples", "actual")


def summary(rows: DataFrame) -> DataFrame:
    """A row a method: weeks, mean scores, coverage of the middle 50, 80 and 95 % and how far it is off, the mean width of the 80 %."""
    q, y = lambda p: F.col("q")[LEVELS.index(p)], F.col("actual")
    inside = lambda a, b: F.avg(((y >= q(a)) & (y <= q(b))).cast("double"))
    got = rows.groupBy("method").agg(
        F.count("*").alias("weeks"), F.avg("crps").alias("crps"), F.avg("absolute_error").alias("mae"), F.avg(F.col("direction_correct").cast("double")).alias("direction"),
        inside(0.25, 0.75).alias("coverage_50"), inside(0.1, 0.9).alias("coverage_80"), inside(0.025, 0.975).alias("coverage_95"), F.avg(q(0.9) - q(0.1)).alias("width_80"), F.avg("percentile").alias("percentile"),
    )
    off = [F.abs(F.col(f"coverage_{p}") - p / 100) for p in (50, 80, 95)]
    return got.withColumn("calibration_error", (off[0] + off[1] + off[2]) / 3)


def interval_join(points: DataFrame, at: str, spans: DataFrame, after: str, until: str, days: int) -> DataFrame:
    """Each point (a date) with each span that it is in: after its one end, until its other. Spans are at most ``days`` long, or are in more buckets: both sides are dealt into buckets of so many days, a point into its own and a span into
    those it touches, so the join is one of equal buckets and no product.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / days)
    touched = F.sequence(bucket(F.date_add(after, 1)), bucket(F.col(until)))
    cut = spans.filter(F.col(after) < F.col(until)).withColumn("bucket_", F.explode(touched))
    return points.withColumn("bucket_", bucket(F.col(at))).join(cut, "bucket_").filter((F.col(at) > F.col(after)) & (F.col(at) <= F.col(until))).drop("bucket_")


def origin_fits(df: DataFrame, key: str, week: str, x: str, origins: DataFrame, weeks: int, least: int) -> DataFrame:
    """(origin, key, n, mu, sd, status) of every origin and key that has a value in the ``weeks`` before the origin: the moments of what lies strictly before it. With fewer than ``least`` values, the status says so."""
    spans = origins.select("origin", F.date_sub("origin", 7 * weeks + 1).alias("after_"), F.date_sub("origin", 1).alias("until_"))
    seen = interval_join(df.filter(F.col(x).isNotNull()).select(key, week, x), week, spans, "after_", "until_", 7 * weeks)
    got = seen.groupBy("origin", key).agg(F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"))
    return got.withColumn("status", F.when(F.col("n") >= least, "completed").otherwise("too_little_history"))


def backtest(df: DataFrame, key: str, week: str, x: str, origins: DataFrame, horizons: Sequence[int], weeks: int = 260, least: int = 104, samples: int = 100, seed: int = 52) -> DataFrame:
    """(origin, key, horizon, actual, method, q, percentile, crps, absolute_error, direction_correct): total returns from each origin(date) on over each horizon, in weeks, against forecasts from what lies before the origin.

    A horizon counts where each of its weeks has a value. Methods: no return, and a Gaussian one with the fit's moments; as only ends count, a horizon is one draw.
    """
    most = max(horizons)
    spans = origins.select("origin", F.date_sub("origin", 1).alias("after_"), F.date_add("origin", 7 * most - 1).alias("until_"))
    ahead = interval_join(df.filter(F.col(x).isNotNull()).select(key, week, x), week, spans, "after_", "until_", 7 * most)
    step = F.floor(F.datediff(week, "origin") / 7) + 1
    ends = F.explode(F.array(*map(F.lit, horizons))).alias("horizon")
    actual = ahead.withColumn("step_", step).select("*", ends).filter(F.col("step_") <= F.col("horizon")).groupBy("origin", key, "horizon").agg(F.sum(x).alias("actual"), F.count("*").alias("seen_")).filter(F.col("seen_") == F.col("horizon"))
    fits = origin_fits(df, key, week, x, origins, weeks, least).filter("status = 'completed'").drop("status")
    rows = actual.drop("seen_").join(fits, ["origin", key])
    at, h = [F.date_format("origin", "yyyy-MM-dd"), F.col(key), F.col("horizon")], F.col("horizon")
    gauss = _draws(samples, lambda k: F.col("mu") * h + F.col("sd") * F.sqrt(h.cast("double")) * normal(seed, "origin", *at, k))
    each = F.array(F.struct(F.lit("zero_return").alias("method"), _draws(samples, lambda k: F.lit(0.0)).alias("samples")), F.struct(F.lit("gaussian").alias("method"), gauss.alias("samples")))
    long = rows.select("origin", key, "horizon", "actual", F.explode(each).alias("m")).select("origin", key, "horizon", "actual", "m.method", "m.samples")
    return scored(long, "samples", "actual")
