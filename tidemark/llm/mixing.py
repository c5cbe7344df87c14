"""Mixing sources to target weights.

Every row gets a hash-random key (the MD5 of its id). Within a source the rows are laid out in key order, in
4096 key ranges, or 16 times as many for each 16 times of 268 million rows; summing each range and then running over the ranges gives the distributed
prefix sums of word counts. A source's budget is whole epochs of it plus the rows before the key at which the prefix sum
reaches what is left. That key lies in one range, so only this range's rows (65,536 at most are expected) are
put in order; all other rows compare their range with the cut. A source that holds most of the rows is thus spread
over as many groups as any other.

Defined results: null text and texts without words have size 0 and take 0 words; a null source is a source of its own, last in
order; a null id has the key of an empty one; equal rows are counted each; an empty table gives an empty table; columns whose
names are taken get an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, fresh, words_of

def range_digits(rows: int) -> int:
    """How many hexadecimal digits of a key name its range: three, or as many as leave 65,536 rows to one."""
    digits = 3
    while rows > 65_536 * 16**digits:
        digits += 1
    return digits


def default_weight(rank: Column) -> Column:
    """5, 2, 1, repeating, by a source's rank from 0."""
    return F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (rank % 3 + 1).cast("int")).cast("long")


def targets(sizes: DataFrame, cap: int = 3, weight=default_weight) -> DataFrame:
    """sizes(src, source_size) to (src, source_size, target): shares of the total by weight, none above ``cap`` times its size.

    What a full source leaves over is shared again by weight: sources are filled in the order of size / weight,
    where the full ones come first, so prefix sums find them all at once. One row a source, in one task.
    """
    named = Window.orderBy(F.col("src").asc_nulls_last())
    fill = Window.orderBy((F.col("source_size").cast("double") / F.col("w")).asc(), F.col("src").asc_nulls_last())
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = lambda c: c.cast("double")
    return (
        sizes.withColumn("w", weight(F.row_number().over(named) - 1))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("full", d(F.col("w") * F.col("left")) > d(F.col("cap") * F.sum("w").over(rest)))
        .withColumn("free_w", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(whole))
        .withColumn("free", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("target", F.when(F.col("full"), d(F.col("cap"))).otherwise(d(F.col("w") * F.col("free")) / d(F.col("free_w"))))
        .select("src", "source_size", "target")
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, weight=default_weight, size_col: str | None = None) -> DataFrame:
    """``df`` with size, source_size, target and taken: the words that the mix takes of each row, repeats counted. ``size_col``: where the sizes are, if they have
    been counted; the text is not read then.

    Each source's ``taken`` add up to its target, rounded down: the row at the cut gives only the words that are missing.
    """
    names = reduce(lambda got, c: got | {c: fresh(df.select("*", *(F.lit(0).alias(x) for x in got.values())), c)}, ("size", "source_size", "target", "taken", "key_", "range_", "src"), {})
    size, key, rng, src = (names[x] for x in ("size", "key_", "range_", "src"))
    sized = F.col(size_col) if size_col else words_of(F.col(text_col))
    keyed = df.withColumn(key, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))).withColumn(rng, F.substring(key, 1, range_digits(df.count())))
    # One row for each source and range: small, and read several times.
    sums = cut(keyed.groupBy(F.col(source_col).alias("src"), F.col(rng).alias("rng")).agg(F.sum(sized).alias("words")))
    plan = targets(sums.groupBy("src").agg(F.sum("words").alias("source_size")), cap, weight)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")).cast("long"))
    run = Window.partitionBy("src").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    joined = at.select(F.col("src").alias("s2"), "rng", "words", "before").join(plan, F.col("s2").eqNullSafe(F.col("src")))
    plan = cut(
        joined.groupBy("src", "source_size", "target", "epochs", "rest").agg(
            F.min(F.when(F.col("before") + F.col("words") >= F.col("rest"), F.col("rng"))).alias("cut_range"),
            F.min(F.when(F.col("before") + F.col("words") >= F.col("rest"), F.struct("rng", "before"))).getField("before").alias("cut_before"),
        )
    )
    plan = plan.select(F.col("src").alias(src), *(F.col(a).alias(f"{src}{a}") for a in ("source_size", "target", "epochs", "rest", "cut_range", "cut_before")))
    p = lambda name: F.col(f"{src}{name}")
    planned = lambda some: some.join(plan, some[source_col].eqNullSafe(plan[src]))
    here = Window.partitionBy(source_col).orderBy(key, size).rowsBetween(Window.unboundedPreceding, -1)
    partial = F.least(F.greatest(p("rest") - p("cut_before") - F.coalesce(F.sum(size).over(here), F.lit(0)), F.lit(0)), F.col(size))
    # Words are counted once for each row: below the join, and at the cut behind the filter.
    outside = planned(keyed.withColumn(size, sized)).filter(F.col(rng) != p("cut_range")).withColumn("part", F.when(F.col(rng) < p("cut_range"), F.col(size)).otherwise(F.lit(0)))
    at_cut = planned(keyed).filter(F.col(rng) == p("cut_range")).withColumn(size, sized).withColumn("part", partial)
    return outside.unionByName(at_cut).select(
        *(F.col(c) for c in df.columns),
        F.col(size).cast("long").alias(size),
        p("source_size").alias(names["source_size"]),
        p("target").alias(names["target"]),
        (p("epochs") * F.col(size) + F.col("part")).cast("long").alias(names["taken"]),
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, weight=default_weight, whole: bool = False) -> DataFrame:
    """The mix itself, in the columns of ``df``: each row as many times as it is taken, the row at a source's cut with its first words only.

    With ``whole``, no text is cut: the row at the cut is taken whole if at least half of its words are missing, and else not, so
    a source is off its target by half a row at most.
    A row of which nothing is taken is left out, as are rows without words.
    """
    plain = df.select(*df.columns)
    got = mix(plain, id_col, text_col, source_col, cap, weight)
    size, taken = got.columns[len(df.columns)], got.columns[-1]
    if whole:
        got = got.withColumn(taken, F.floor(F.col(taken) / F.greatest(F.col(size), F.lit(1)) + 0.5).cast("long") * F.col(size))
    copy = fresh(got, "copy_")
    copies = got.filter(F.col(taken) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.greatest(F.col(size), F.lit(1))).cast("int"))))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")), 1, words.cast("int")), " ")
    return copies.withColumn(text_col, F.when(words < F.col(size), first).otherwise(F.col(text_col))).select(*df.columns)
