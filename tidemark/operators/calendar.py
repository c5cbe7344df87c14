"""Weeks that end on Fridays, calendars, folds and other matters of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_of(day: Column) -> Column:
    """The Friday on or after a day: weeks are Saturday to Friday, named by their end."""
    return F.next_day(F.date_sub(day, 1), "Fri")


def calendar(start: Column, stop: Column, days: int = 7) -> Column:
    """Every ``days`` days from start to stop, an array of dates."""
    return F.sequence(start, stop, F.expr(f"interval {days} days"))


def weeks_between(df: DataFrame, week: str = "week") -> DataFrame:
    """All weeks from the first to the last of ``df``, also those without rows."""
    return df.agg(F.min(week).alias("a"), F.max(week).alias("b")).select(F.explode(calendar(F.col("a"), F.col("b"))).alias(week))


def spine(df: DataFrame, key: str, week: str = "week") -> DataFrame:
    """Each key in each week of the whole calendar."""
    days = weeks_between(df, week).agg(F.collect_list(week).alias("all"))  # one row, a date a week
    return df.select(key).distinct().crossJoin(F.broadcast(days)).select(key, F.explode("all").alias(week))


def weekly_last(df: DataFrame, key: str, day: str, value: str, order: Sequence[str]) -> DataFrame:
    """The last value that is not null of each key and week."""
    seen = df.filter(F.col(value).isNotNull()).withColumn("week", week_of(F.col(day)))
    return seen.groupBy(key, "week").agg(F.max_by(value, F.struct(day, *order)).alias(value))


def forward_fill(df: DataFrame, key: str, week: str, value: str, limit: int) -> DataFrame:
    """Nulls become the last value of at most ``limit`` rows before."""
    w = Window.partitionBy(key).orderBy(week).rowsBetween(-limit, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def fold_bounds(rows: int, folds: int, least: int) -> list[tuple[int, int, int]]:
    """(fold, end of training, end of the held-out part): equal steps from ``least`` to ``rows``, in whole numbers."""
    if rows <= least or folds < 1:
        raise ValueError("too few rows for the folds")
    cuts = [int(least + (rows - least) * i / folds) for i in range(folds + 1)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def expanding_folds(df: DataFrame, order: str, folds: int, least: int) -> DataFrame:
    """Each fold's rows by position, with their part: train before its end, held up to its own. Bounds as of ``fold_bounds``, from the number of
    rows there are; too few rows have no folds.
    """
    numbered = df.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1).withColumn("rows", F.count("*").over(Window.partitionBy()))  # one row a week
    end = lambda i: (F.lit(least) + F.floor((F.col("rows") - least) * i / folds)).cast("long")
    bounds = F.array(*(F.struct(F.lit(i).cast("long").alias("fold"), end(i).alias("train_end"), end(i + 1).alias("held_end")) for i in range(folds)))
    got = numbered.filter(F.col("rows") > least).select("*", F.explode(bounds).alias("f")).select(*df.columns, "pos", "f.*").filter("pos < held_end and train_end < held_end")
    return got.withColumn("part", F.when(F.col("pos") < F.col("train_end"), "train").otherwise("held"))


def between(df: DataFrame, column: str, after: str, until: str) -> DataFrame:
    """Rows after one day and until another, the latter included."""
    return df.filter((F.col(column) > F.lit(after).cast("date")) & (F.col(column) <= F.lit(until).cast("date")))
