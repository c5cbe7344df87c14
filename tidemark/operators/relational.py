"""Keyed tables: last of each key, duplicates, merges, queues, assignments, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: a maximum by the order, taken before the shuffle as well, so large groups need no sort."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return got.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both tables' rows, the last of each key; columns that one lacks are null."""
    return last_per_key(old.unionByName(new, allowMissingColumns=True), keys, order)


def shared_values(df: DataFrame, column: str) -> DataFrame:
    """Values of more than one row."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").select(column)


def demote_duplicates(df: DataFrame, column: str, flag: str) -> DataFrame:
    """``flag`` becomes false in every row whose value is flagged in more than one."""
    twice = shared_values(df.filter(F.col(flag)), column).withColumn("twice", F.lit(True))
    return df.join(twice, column, "left").withColumn(flag, F.col(flag) & F.col("twice").isNull()).drop("twice")


def merge_previous(current: DataFrame, previous: DataFrame, key: str, columns: Sequence[str], flag: str) -> DataFrame:
    """The previous row's columns where the current one is not verified, or the previous one is."""
    old = previous.select(F.col(key).alias("k"), *(F.col(c).alias(f"old_{c}") for c in columns))
    both = current.join(old, F.col(key) == F.col("k"), "left")
    take = F.col("k").isNotNull() & (~F.col(flag) | F.col(f"old_{flag}"))
    return both.select(*(F.when(take, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def update_where(df: DataFrame, keys: DataFrame, key: str, changes: dict[str, Column], unless: Column) -> DataFrame:
    """New values in the rows whose key is listed, except where ``unless`` holds."""
    hit = df.join(keys.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    on = F.col("hit").isNotNull() & ~unless
    return hit.select(*(F.when(on, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))


def greedy_assignment(candidates: DataFrame, valid: DataFrame, rounds: int) -> DataFrame:
    """candidates(key, nth, symbol) to (key, symbol, nth): in round n each open key asks for its n-th symbol; it gets it if it is valid, still free, and asked for by no other.

    Rounds are few and fixed; each is one aggregation and two joins on keys.
    """
    done = None
    for n in range(rounds):
        asked = candidates.filter(F.col("nth") == n).join(valid, "symbol", "left_semi")
        if done is not None:
            asked = asked.join(done.select("key"), "key", "left_anti").join(done.select("symbol"), "symbol", "left_anti")
        alone = asked.groupBy("symbol").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1").select("key", "symbol", F.lit(n).alias("nth"))
        done = alone if done is None else done.unionByName(alone)
    return done


def replace_part(df: DataFrame, new: DataFrame, part: Column) -> DataFrame:
    """The rows outside ``part``, and the new ones."""
    return df.filter(~part).unionByName(new)


def align(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns, by name and type; what is missing is null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()))


def ranked_with_margin(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Each group's best row and by how much it leads."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w)).filter("rank = 1").drop("rank")


def pending(wanted: DataFrame, manifest: DataFrame, files: DataFrame, end: DataFrame, key: str, days: int = 10) -> DataFrame:
    """The rows of ``wanted`` that are not done: done is what the manifest (key, status, last_date) has as ok, with a file (key), and with data up to
    ``days`` before the requested end (a table of one row).
    """
    late = F.date_sub("requested_end", days)
    done = manifest.filter("status = 'ok'").crossJoin(F.broadcast(end)).filter(F.col("last_date") >= late).join(files, key, "left_semi")  # by one row
    return wanted.join(done.select(key), key, "left_anti")


def audit_mappings(df: DataFrame, similarity: Column, least: float = 0.55) -> DataFrame:
    """``df`` (ticker, country, method, resolved, was) with the first reason against each verified mapping; what has one is reset."""
    land = F.upper(F.trim(F.coalesce("country", F.lit(""))))
    ticker = F.trim(F.coalesce("ticker", F.lit("")))
    elsewhere = (land != "") & (land != "US")
    unlike = (F.coalesce("resolved", F.lit("")) != "") & (F.col("method") != "direct_symbol") & (similarity < least)
    reason = F.when(~F.col("was"), None).when(ticker == "", "blank").when((F.col("method") == "direct_symbol") & elsewhere, "bare_symbol")
    reason = reason.when((land != "") & ~text.compatible(F.col("country"), ticker), "suffix_mismatch").when(unlike, "name_mismatch")
    kept = lambda c, other: F.when(F.col("reason").isNull(), F.col(c)).otherwise(other).alias(c)
    got = df.withColumn("reason", reason)
    reset = {"ticker": "", "method": "", "was": False}
    return got.select(*(kept(c, F.lit(reset[c])) if c in reset else F.col(c) for c in got.columns))
