"""Quantiles, scores, coverage, selection rules and autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (0.025, 0.10, 0.25, 0.5, 0.75, 0.90, 0.975)


def mean_and_error(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """The mean, its standard error (0 for one value, null for none) and the count."""
    n = F.count(x)
    error = F.when(n > 1, F.stddev_samp(x) / F.sqrt(n.cast("double"))).when(n == 1, F.lit(0.0))
    return df.groupBy(*group).agg(F.avg(x).alias("mean"), error.alias("error"), n.alias("n"))


def one_error_rule(df: DataFrame, rank: str, gate: str, gate_error: str, metric: str, metric_error: str) -> DataFrame:
    """The smallest rank within one standard error of the best, twice: first by the gate, then, of those, by the metric. A row a rank comes in."""
    best = df.agg(F.min_by(F.struct(gate, gate_error), F.struct(gate, rank)).alias("b")).select((F.col(f"b.{gate}") + F.col(f"b.{gate_error}")).alias("most"))
    passed = df.crossJoin(F.broadcast(best)).filter(F.col(gate) <= F.col("most")).drop("most")  # by one row
    best = passed.agg(F.min_by(F.struct(metric, metric_error), F.struct(metric, rank)).alias("b")).select((F.col(f"b.{metric}") + F.col(f"b.{metric_error}")).alias("most"))
    return passed.crossJoin(F.broadcast(best)).filter(F.col(metric) <= F.col("most")).agg(F.min(rank).alias("selected"))


def autocorrelation(df: DataFrame, order: str, x: str, most: int) -> DataFrame:
    """(lag, rho, n) of one series of n values, for lags from 1 to ``most``, n / 4 at the most; rho is null for a flat series."""
    whole = Window.partitionBy()
    w = Window.orderBy(order)
    d = df.withColumn("d", F.col(x) - F.avg(x).over(whole)).withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(whole))  # one short series
    lags = F.explode(F.array(*map(F.lit, range(1, most + 1)))).alias("lag")
    ahead = d.select((F.col("pos")).alias("p2"), F.col("d").alias("d2"))
    total = d.agg(F.sum(F.col("d") * F.col("d")).alias("total"))
    pairs = d.select("pos", "d", "n", lags).filter(F.col("lag") <= F.floor(F.col("n") / 4)).join(ahead, F.col("p2") == F.col("pos") + F.col("lag"))
    return pairs.groupBy("lag").agg(F.sum(F.col("d") * F.col("d2")).alias("c"), F.max("n").alias("n")).crossJoin(F.broadcast(total)).select("lag", F.when(F.col("total") > 1e-12, F.col("c") / F.col("total")).alias("rho"), "n")


def block_length(rho: DataFrame, run: int = 3) -> DataFrame:
    """(lag, rho, n) to the length of blocks: where the first ``run`` weak lags in a row begin, weak being below 1.96 / sqrt(n); the last lag, if none do; 2 at least, and for series that are flat or have fewer than 12 values."""
    w = Window.orderBy("lag").rowsBetween(1 - run, 0)  # a row a lag
    weak = F.sum((F.abs("rho") < 1.96 / F.sqrt("n")).cast("int")).over(w)
    ended = rho.withColumn("weak", weak).agg(F.min(F.when(F.col("weak") == run, F.col("lag"))).alias("stop"), F.max("lag").alias("last"), (F.max("rho").isNull() | (F.max("n") < 12)).alias("none"))
    return ended.select(F.when(F.col("none"), F.lit(2)).otherwise(F.greatest(F.lit(2), F.coalesce(F.col("stop") - (run - 1), F.col("last"), F.lit(2)))).alias("block"))


#: The speed of a turn by the angle that is left, and the correction by the heading's error: above the first number, the second.
TURN_SPEED = [(45, 30), (20, 20), (None, 10)]
HEADING_CORRECTION = [(20, 15), (10, 10), (3, 5), (None, 0)]


def banded(x: Column, bands: Sequence[tuple[float | None, int]]) -> Column:
    """The value of the first band whose lower bound x is above."""
    out = F.when(F.lit(False), 0)
    for least, value in bands[:-1]:
        out = out.when(x > least, value)
    return out.otherwise(bands[-1][1])


def direction_back(x: Column, y: Column) -> Column:
    """The angle of a vector, turned by half into (-180, 180]; with x next to 0 it is 90, -90 or 0 before the turn."""
    flat = F.when(y > 0, 90.0).when(y < 0, -90.0).otherwise(0.0)
    a = F.when(F.abs(x) < 0.001, flat).otherwise(F.degrees(F.atan2(y, x))) + 180
    return F.when(a > 180, a - 360).when(a <= -180, a + 360).otherwise(a)
