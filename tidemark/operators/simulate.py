"""Walks, games, bootstraps and other simulations on counter-based random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rng import uniform


def walkers(spark: SparkSession, walks: int | DataFrame) -> DataFrame:
    """A table of walks: as it is, with a column walk, or so many by number."""
    return walks if isinstance(walks, DataFrame) else spark.range(walks).withColumnRenamed("id", "walk")


def grid(spark: SparkSession, walks: int | DataFrame, steps: int) -> DataFrame:
    """The walks with step from 1: walks are dealt out, and each makes its own steps."""
    return walkers(spark, walks).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))).alias("step"))


def _run(column: Column) -> Column:
    return F.sum(column).over(Window.partitionBy("walk").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))


def walk_1d(spark: SparkSession, walks: int | DataFrame, steps: int, seed: int = 52, p: float | Column = 0.5) -> DataFrame:
    """Steps up with probability ``p``, a number or a column of the walks, and else down."""
    s = grid(spark, walks, steps).withColumn("d", F.when(uniform(seed, F.col("walk"), F.col("step")) < p, 1).otherwise(-1))
    return s.withColumn("x", _run(F.col("d"))).drop("d")


def walk_2d(spark: SparkSession, walks: int | DataFrame, steps: int, kind: str, seed: int = 52) -> DataFrame:
    """kind: angle (unit steps in any direction), grid4 (four neighbours) or grid8 (eight neighbours, or staying)."""
    s = grid(spark, walks, steps).withColumn("u", uniform(seed, kind, F.col("walk"), F.col("step")))
    if kind == "angle":
        dx, dy = F.cos(2 * math.pi * F.col("u")), F.sin(2 * math.pi * F.col("u"))
    elif kind == "grid4":
        k = F.floor(F.col("u") * 4)
        dx, dy = F.when(k == 0, 1).when(k == 1, -1).otherwise(0), F.when(k == 2, 1).when(k == 3, -1).otherwise(0)
    else:
        k = F.floor(F.col("u") * 9)
        dx, dy = k % 3 - 1, F.floor(k / 3) - 1
    return s.withColumn("x", _run(dx.cast("double"))).withColumn("y", _run(dy.cast("double"))).drop("u")


def ruin(spark: SparkSession, games: int | DataFrame, cap: int, first: int | Column, second: int | Column, p: float | Column, seed: int = 52) -> DataFrame:
    """(game, steps, first_won) of gambler's ruin: the first step at which one has all; at the cap, the larger bankroll wins. Bankrolls and odds may be columns of the games, which have a column walk."""
    of = lambda v: v if isinstance(v, Column) else F.lit(v)
    run = walk_1d(spark, walkers(spark, games).withColumn("first_", of(first)).withColumn("second_", of(second)), cap, seed, p)
    end = F.min(F.when((F.col("x") >= F.col("second_")) | (F.col("x") <= -F.col("first_")), F.struct("step", "x")))
    g = run.groupBy("walk", "first_", "second_").agg(end.alias("e"), F.max_by("x", "step").alias("last"))
    x = F.coalesce(F.col("e.x"), F.col("last"))
    won = F.when(F.col("e").isNotNull(), x > 0).otherwise(F.col("first_") + x > F.col("second_") - x)
    return g.select(F.col("walk").alias("game"), F.coalesce(F.col("e.step"), F.lit(cap)).cast("long").alias("steps"), won.alias("first_won"))


def stationary_bootstrap(source: DataFrame, spark: SparkSession, paths: int, steps: int, length: int, mean_block: float, seed: int = 52) -> DataFrame:
    """source(pos, r), pos from 0 to length-1. A block starts at a random place, ends with probability 1 / mean_block a step, and wraps around."""
    s = grid(spark, paths, steps)
    fresh = (F.col("step") == 1) | (uniform(seed, "restart", F.col("walk"), F.col("step")) < 1.0 / mean_block)
    w = Window.partitionBy("walk").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    start = F.floor(uniform(seed, "start", F.col("walk"), F.col("step")) * length)
    s = s.withColumn("begin", F.last(F.when(fresh, F.struct("step", start.alias("at"))), ignorenulls=True).over(w))
    s = s.select("walk", "step", ((F.col("begin.at") + F.col("step") - F.col("begin.step")) % length).alias("pos"))
    return s.join(source, "pos").select("walk", "step", "pos", "r")


def paired_block_means(source: DataFrame, spark: SparkSession, reps: int, block: int, length: int, seed: int = 52) -> DataFrame:
    """(rep, mean) of circular block resamples of source(pos, d)."""
    blocks = -(-length // block)
    r = spark.range(reps).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    r = r.withColumn("start", F.floor(uniform(seed, F.col("rep"), F.col("b")) * length)).select("rep", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    r = r.filter(F.col("b") * block + F.col("o") < length).withColumn("pos", (F.col("start") + F.col("o")) % length)
    return r.join(source, "pos").groupBy("rep").agg(F.avg("d").alias("mean"))


def categorical(key: list, weights: list[float]) -> Column:
    """The index drawn by the inverse of the cumulative weights."""
    u = uniform(*key) * float(sum(weights))
    out, total = F.when(F.lit(False), 0), 0.0
    for i, w in enumerate(weights[:-1]):
        total += w
        out = out.when(u < total, i)
    return out.otherwise(len(weights) - 1)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt to several tasks a core: a small file of walks is one split, however long its rows' work is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


def _fold(spark: SparkSession, walks: int | DataFrame, trials: int, kind: str, seed: int, start: Column, step) -> DataFrame:
    """A walk whose next state depends on its state: a fold over its own trials, one row a walk, in the JVM. ``step`` takes the state and the place that the trial's turn leads to.

    Turns depend on no state, so they are drawn before the fold, each once; so is each place, although the step names it often.
    """
    angle = lambda k: 2 * math.pi * uniform(seed, kind, F.col("walk"), k)
    turns = F.transform(F.sequence(F.lit(1), F.lit(trials)), lambda k: F.get(F.transform(F.array(angle(k)), lambda a: F.struct(F.cos(a).alias("x"), F.sin(a).alias("y"))), F.lit(0)))

    def moved(s: Column, turn: Column) -> Column:
        there = F.struct((s["x"] + turn["x"]).alias("x"), (s["y"] + turn["y"]).alias("y"))
        return F.get(F.transform(F.array(there), lambda to: step(s, to)), F.lit(0))

    return spread(walkers(spark, walks), "walk").withColumn("s", F.aggregate(turns, start, moved))


def box_walk(spark: SparkSession, walks: int | DataFrame, trials: int, half_width: float | Column, half_height: float | Column, seed: int = 52, strict: bool = True) -> DataFrame:
    """Steps of angle that stay in a box around the origin; a step that would leave it is drawn again. (walk, x, y, accepted)"""

    def step(s: Column, to: Column) -> Column:
        x, y = to["x"], to["y"]
        inside = (F.abs(x) < half_width) & (F.abs(y) < half_height) if strict else (F.abs(x) <= half_width) & (F.abs(y) <= half_height)
        return F.when(inside, F.struct(x.alias("x"), y.alias("y"), (s["n"] + 1).alias("n"))).otherwise(s)

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("n"))
    return _fold(spark, walks, trials, "box", seed, start, step).select("walk", "s.x", "s.y", F.col("s.n").alias("accepted"))


def target_walk(spark: SparkSession, walks: int | DataFrame, trials: int, half: float | Column, target: tuple[float | Column, ...], seed: int = 52) -> DataFrame:
    """As in a box, until a step hits the target (left, bottom, width, height): (walk, hit, moves). The target is tested first, then the border."""
    left, low, width, height = target

    def step(s: Column, to: Column) -> Column:
        x, y = to["x"], to["y"]
        hit = x.between(left, left + width) & y.between(low, low + height)
        moves = hit | ((F.abs(x) <= half) & (F.abs(y) <= half))
        return F.when(~s["hit"] & moves, F.struct(x.alias("x"), y.alias("y"), (s["n"] + 1).alias("n"), hit.alias("hit"))).otherwise(s)

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("hit"))
    return _fold(spark, walks, trials, "target", seed, start, step).select("walk", "s.hit", F.col("s.n").alias("moves"))
