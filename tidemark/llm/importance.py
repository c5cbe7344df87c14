"""Importance resampling to a target distribution: documents whose hashed n-grams are likelier in the target than in the corpus are drawn more often.

1. Each text becomes an array of buckets, one for each n-gram, by higher-order functions; it is written once, in a few bytes an n-gram, and texts are not read again.
2. Counts of buckets, over all of the corpus and all of the target: tasks add them up, so that no more than one row a bucket and task is shuffled. From them comes a gain for each bucket: the log of
   the smoothed ratio of its shares, in whole thousandths.
3. A document's weight is the mean of its buckets' gains, added up in place over a literal array of all gains (``buckets`` numbers, whatever the corpus): nothing is exploded or joined.
4. Gumbel noise from a hash of the id turns drawing without replacement by weight into taking the highest scores. Places in their order come from ranges, of eligible documents only.

Defined results: a null text has no words; a document without n-grams weighs 0; an empty target gives gains by smoothing alone; equal rows count and are drawn one by one; a null id hashes as an empty string and comes
after all others among equal scores; documents that tie in score and id are ranked by a hash of their figures; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Table, cut
from tidemark.operators import order

BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters A to Z count as words' characters, as they are lower-cased after the cut.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case, other letters as they are."""
    lower = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})")), lower)


def bucket_array(some: Column, low: int, high: int, buckets: int) -> Column:
    """The bucket of each run of ``low`` to ``high`` words."""
    bucket = lambda gram: F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")

    def of(n: int) -> Column:
        if n == 1:
            return F.transform(some, bucket)
        starts = F.when(F.size(some) >= n, F.sequence(F.lit(1), F.size(some) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(some, i, n), " ")))

    runs = [of(n) for n in range(low, high + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def hashed(df: DataFrame, text_col: str, low: int, high: int, buckets: int, **kept: str) -> DataFrame:
    """(the kept columns under their new names, n_words, buckets)."""
    cut_up = df.select(*(F.col(c).alias(new) for new, c in kept.items()), words(F.col(text_col)).alias("w"))
    return cut_up.select(*kept, F.size("w").alias("n_words"), bucket_array(F.col("w"), low, high, buckets).alias("buckets"))


def totals(some: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: one row a bucket."""
    return {r["b"]: r["n"] for r in some.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """For each bucket, a thousand times the log of the ratio of its share in the target to that in the corpus, one being added to each count; rounded down."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + buckets) / ((corpus.get(b, 0) + 1.0) * (t + buckets)))) for b in range(buckets)]


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; rank counts from 1 over the drawn ones, ``percent`` in a hundred of those with ``least_words`` words or more, and is null for the rest."""
    table = Table(hashed(docs, text_col, low, high, buckets, id=id_col))
    gain = gains(totals(table.read()), totals(hashed(target, target_col, low, high, buckets)), buckets)
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into a constant
    added = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    scored = table.read().select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), added.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = cut(scored.select("id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    table.drop()
    open_ = scored.filter(F.col("n_words") >= least_words)
    drawn = open_.count() * percent // 100
    placed = order.places(open_, F.desc("score"), F.col("id").asc_nulls_last())
    ranked = placed.withColumn("rank", F.when(F.col("nth") < drawn, F.col("nth") + 1)).drop("nth")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
