"""Connected components by distributed union-find: large stars and small stars in turns, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component): for every node that has an edge to another, the smallest node it is connected with.

    Each round hangs every node, with its neighbours, under the smallest one it sees: first its larger neighbours, then its smaller ones. Trees
    get flat in a number of rounds that grows with the logarithm of the longest path. A hub's edges meet in joins on
    the hub, which Spark can split, and in minima that are taken before the shuffle. Rounds are cut by checkpoints.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        under = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(under.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, state(e)
        if now == before:
            break
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
