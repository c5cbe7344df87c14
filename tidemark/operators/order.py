"""Places and sums in a total order, exact quantiles and pairwise spreads, without any task that holds a whole table or group.

Places: Spark's range partitioning (bounds from a sample) puts rows in order over many tasks, rows are counted within each range, and the counts of the ranges before are added:
one row a range is all that a single task sees. Quantiles and spreads: cuts from a sketch of bounded size split each group into value ranges, whose exact counts say where each range begins in the group's order.
The sketch only says where to cut. Results are exact wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import keep

ACCURACY = 10_000  # of sketches: ranks are off by a 10,000th of a group at most
RANGES = 256  # of values in a group, for sums over its order; a square


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, changed so far that none is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def places(df: DataFrame, *order: Column | str, name: str = "nth") -> DataFrame:
    """``df`` with each row's place from 0 in the order of the keys (columns of any sortable type, or ``F.desc`` and the like).

    Ties are put in the order of a hash of the whole row, so that the range bounds can split them too; rows that are equal in all columns are next to each
    other, in no order of their own, and stay in one range. Nulls are sorted as Spark does. The ordered rows are kept in the shared folder, so that
    ranges and their counts are of one and the same sort whatever is lost.
    """
    part, local, tie, begin, size = fresh(df, "part_", "local_", "tie_", "begin_", "size_")
    ordered = df.withColumn(tie, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).orderBy(*order, tie).drop(tie)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # Spark counts rows in the low bits
    kept = keep(ordered.withColumn(part, F.spark_partition_id()).withColumn(local, row))
    return kept.join(F.broadcast(_begins(kept, part, size, {begin: F.count("*")})), part).withColumn(name, F.col(local) + F.col(begin)).select(*df.columns, name)


def _begins(kept: DataFrame, part: str, size: str, totals: Mapping[str, Column]) -> DataFrame:
    """(part, for each total its sum over the parts before): a row a range."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy(part).agg(*(x.alias(f"{size}{c}") for c, x in totals.items()))
    return sums.select(part, *(F.coalesce(F.sum(f"{size}{c}").over(before), F.lit(0)).alias(c) for c in totals))


def folds(df: DataFrame, *order: Column | str, n: int, name: str = "fold") -> DataFrame:
    """``df`` cut into n runs of the order, from 1, as even as can be, the longer ones first."""
    size, nth, count = F.floor(F.col("count_") / n), F.col("nth_"), F.col("count_")
    placed = places(df, *order, name="nth_")
    long = (count % n) * (size + 1)  # rows in longer runs
    fold = F.when(nth < long, F.floor(nth / (size + 1))).otherwise(count % n + F.floor((nth - long) / F.greatest(size, F.lit(1))))
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("count_")))).select(*df.columns, (fold + 1).alias(name))  # by one row


def running_sums(df: DataFrame, *order: Column | str, sums: Mapping[str, str]) -> DataFrame:
    """``df`` with, for each new column of ``sums``, the sum of the named column over the rows up to this one in the order of the keys; nulls add nothing. Ties as in ``places``."""
    part, local, tie, size, *begins = fresh(df, "part_", "local_", "tie_", "size_", *(f"begin_{c}" for c in sums))
    ordered = df.withColumn(tie, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).orderBy(*order, tie).drop(tie)
    kept = keep(ordered.withColumn(part, F.spark_partition_id()).withColumn(local, F.monotonically_increasing_id()))
    here = Window.partitionBy(part).orderBy(local).rowsBetween(Window.unboundedPreceding, 0)
    starts = _begins(kept, part, size, {b: F.sum(c) for b, c in zip(begins, sums.values(), strict=True)})
    got = kept.join(F.broadcast(starts), part)
    return got.select(*df.columns, *((F.coalesce(F.sum(c).over(here), F.lit(0)) + F.col(b)).alias(new) for b, (new, c) in zip(begins, sums.items(), strict=True)))


def same(left: DataFrame, right: DataFrame, columns: Sequence[str], prefix: str, how: str = "inner", hint: bool = False) -> DataFrame:
    """``left`` joined to ``right`` by equal columns, nulls being equal; the right side's columns are renamed with the prefix for the comparison and dropped."""
    named = right.select(*(F.col(c).alias(prefix + c) if c in columns else F.col(c) for c in right.columns))
    if hint or not columns:
        named = F.broadcast(named)  # without columns: one row
    if not columns:
        return left.crossJoin(named)
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns))
    return left.join(named, on, how).drop(*(prefix + c for c in columns))


def _range_of(x: Column, cuts: Column, n: int) -> Column:
    """How many of the n sorted cuts x is above: first by every sixteenth, then within."""
    above = lambda at: F.coalesce((x > F.get(cuts, at)).cast("int"), F.lit(0))
    if n <= 32:
        return reduce(lambda a, b: a + b, (above(F.lit(i)) for i in range(n)))
    block = reduce(lambda a, b: a + b, (above(F.lit(16 * j + 15)) for j in range(n // 16)))
    return block * 16 + reduce(lambda a, b: a + b, (above(block * 16 + i) for i in range(15)))


def value_ranges(df: DataFrame, group: Sequence[str], x: str, levels: Sequence[float], accuracy: int = ACCURACY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each group cut at about these levels of its values: (rows with x not null and rng_, the number of their range; a row a group: n_; a row a range: start_ and size_ in the group's order).

    Equal values share a range. The sketch that finds the cuts holds some ``accuracy`` values a group.
    """
    rows = df.filter(F.col(x).isNotNull())
    sketch = F.percentile_approx(x, F.array(*map(F.lit, levels)), F.lit(accuracy))
    groups = rows.groupBy(*group).agg(F.count("*").alias("n_"), sketch.alias("cuts_"))
    cut = same(rows, groups.select(*group, "cuts_"), group, "g_").withColumn("rng_", _range_of(F.col(x), F.col("cuts_"), len(levels))).drop("cuts_")
    before = Window.partitionBy(*group).orderBy("rng_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = cut.groupBy(*group, "rng_").agg(F.count("*").alias("size_"))
    return cut, groups.select(*group, "n_"), sizes.withColumn("start_", F.coalesce(F.sum("size_").over(before), F.lit(0)))


def quantiles(df: DataFrame, group: Sequence[str], x: str, levels: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(group, n, q): the exact quantiles of x in each group, interpolated between neighbours, as an array by level; n counts values. A group without values has n = 0 and nulls; an empty table without groups gives no row.

    Only the ranges that hold a wanted rank go on: some 4 / accuracy of a group for each level, and what is equal to them. They are counted by value, and then put in order by range.
    """
    near = 2 / accuracy
    edges = sorted({min(max(p + e, 0.0), 1.0) for p in levels for e in (-near, near)})
    cut, groups, ranges = value_ranges(df, group, x, edges, accuracy)
    at = lambda p: (F.col("n_") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in levels))))
    wanted = groups.select(*group, F.explode(ranks).alias("rank_"))
    held = same(wanted, ranges, group, "r_").filter((F.col("rank_") >= F.col("start_")) & (F.col("rank_") < F.col("start_") + F.col("size_")))
    keys = [*group, "rng_"]
    values = same(cut, held.select(*keys).distinct(), keys, "h_").groupBy(*keys, F.col(x).alias("x_")).agg(F.count("*").alias("m_"))
    run = Window.partitionBy(*keys).orderBy("x_").rowsBetween(Window.unboundedPreceding, -1)
    run = values.withColumn("before_", F.coalesce(F.sum("m_").over(run), F.lit(0)))
    inside = F.col("rank_") - F.col("start_") - F.col("before_")
    found = same(run, held, keys, "h_").filter((inside >= 0) & (inside < F.col("m_"))).select(*group, "rank_", F.col("x_").cast("double").alias("x_"))
    all_groups = df.groupBy(*group).agg(F.count(x).alias("n_"))
    joined = same(all_groups, found, group, "f_", "left") if group else all_groups.join(found, F.lit(True), "left")
    value = lambda rank: F.max(F.when(F.col("rank_") == rank, F.col("x_")))
    picks = [c for i, p in enumerate(levels) for c in (value(F.floor(at(p))).alias(f"lo{i}_"), value(F.ceil(at(p))).alias(f"hi{i}_"))]
    got = joined.groupBy(*group, "n_").agg(*picks)
    low, high = (lambda i: F.col(f"lo{i}_")), (lambda i: F.col(f"hi{i}_"))
    between = lambda i, p: F.when(low(i) == high(i), low(i)).otherwise(low(i) * (F.ceil(at(p)) - at(p)) + high(i) * (at(p) - F.floor(at(p))))
    return got.select(*group, F.col("n_").alias("n"), F.array(*(between(i, p) for i, p in enumerate(levels))).alias("q"))


def crps(samples: DataFrame, group: Sequence[str], x: str, actual: str, accuracy: int = ACCURACY) -> DataFrame:
    """(group, crps): the continuous ranked probability score of each group's samples, E|x - y| less half the mean distance of two samples. Null samples play no part.

    The sum over all pairs is one over places: m equal values with c below them, of n, add x * m * (2c + m - n). A place is the start of the value's range and the count before it in the range, so
    a group of any size is put in order in ``RANGES`` parts, and equal values are counted before that.
    """
    cut, groups, ranges = value_ranges(samples, group, x, [i / RANGES for i in range(1, RANGES)], accuracy)
    keys = [*group, "rng_"]
    values = cut.groupBy(*keys, F.col(x).cast("double").alias("x_")).agg(F.count("*").alias("m_"), F.sum(F.abs(F.col(x) - F.col(actual))).alias("off_"))
    run = Window.partitionBy(*keys).orderBy("x_").rowsBetween(Window.unboundedPreceding, -1)
    run = values.withColumn("before_", F.coalesce(F.sum("m_").over(run), F.lit(0)))
    within = F.col("x_") * F.col("m_") * (2 * F.col("before_") + F.col("m_"))
    sums = same(run, ranges, keys, "r_").groupBy(*keys).agg(F.sum("off_").alias("off_"), F.sum(F.col("x_") * F.col("m_")).alias("mass_"), F.sum(within).alias("inner_"), F.max("start_").alias("start_"))
    total = same(sums, groups, group, "g_").groupBy(*group, "n_").agg(F.sum("off_").alias("off_"), F.sum(F.col("inner_") + F.col("mass_") * (2 * F.col("start_") - F.col("n_"))).alias("spread_"))
    n = F.col("n_").cast("double")
    return total.select(*group, (F.col("off_") / n - F.col("spread_") / (n * n)).alias("crps"))
