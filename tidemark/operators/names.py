"""Joining names that are alike: an inverted index of their characters finds the candidates, the exact Ratcliff-Obershelp ratio decides.

A ratio is 2 M / (m + n) for names of m and n characters of which M match, in blocks of common substrings. From a least ratio follows what two names share at least, so that nothing is lost:

* lengths: n >= m r / (2 - r), and so a mean length of at least m / (2 - r);
* single characters: the M matched ones, M >= r (m + n) / 2;
* pairs of neighbours: blocks are kept apart by characters that don't match, so there are at most m + n - 2 M + 1 of them, each with one pair less than characters: M less that many, (3 r - 2) (m + n) / 2 - 1.

A name is filed under its rarest pairs only, as many as it can't do without: two names that share enough have one of them in common (prefix filtering). Names too short to need a pair are filed under their rarest characters too. Each different name is compared
once, whatever its rows; hot pairs are in no short prefix, as the rarest come first, and the join on them is one that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import special

_LITTLE = 1e-9  # for rounding up what is whole but for its last bit


def _pieces(name: Column) -> tuple[Column, Column]:
    """The characters of a name, and its pairs of neighbours, each with how often it came before in the name, so that both are sets."""
    at = lambda n: F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - (n - 1))).otherwise(F.array().cast("array<int>"))
    numbered = lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.lit("\x00"), F.size(F.filter(F.slice(xs, 1, i), lambda y: y == x)).cast("string")))
    return numbered(F.transform(at(1), lambda i: F.substring(name, i, 1))), numbered(F.transform(at(2), lambda i: F.substring(name, i, 2)))


def _filed(names: DataFrame, least: float) -> DataFrame:
    """names(bare) to (bare, chars, token, prefix, kind): everything a name could be filed under, and how many of its rarest it needs."""
    chars, pairs = _pieces(F.col("bare"))
    n = F.length("bare")
    mean = n / (2 - least)  # of the two lengths, at least
    need_pairs = F.ceil((3 * least - 2) * mean - 1 - _LITTLE) if least > 2 / 3 else F.lit(0)
    need_chars = F.greatest(F.ceil(least * mean - _LITTLE), F.lit(1))
    some = names.select("bare", chars.alias("chars"), pairs.alias("pairs"), need_pairs.alias("need_pairs"), need_chars.alias("need_chars"))
    empty = F.struct(F.lit("e").alias("kind"), F.array(F.lit("")).alias("tokens"), F.lit(1).alias("prefix"))
    by_pairs = F.struct(F.lit("p").alias("kind"), F.col("pairs").alias("tokens"), (F.size("pairs") - F.greatest(F.col("need_pairs"), F.lit(1)) + 1).cast("int").alias("prefix"))
    by_chars = F.struct(F.lit("c").alias("kind"), F.col("chars").alias("tokens"), (F.size("chars") - F.col("need_chars") + 1).cast("int").alias("prefix"))
    kinds = F.when(F.col("bare") == "", F.array(empty)).when(F.col("need_pairs") >= 1, F.array(by_pairs)).otherwise(F.array(by_chars, by_pairs) if least > 2 / 3 else F.array(by_chars))
    return some.select("bare", "chars", F.explode(kinds).alias("k")).select("bare", "chars", "k.kind", "k.prefix", F.explode("k.tokens").alias("token"))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left(name) and right(name) to (left_name, right_name, similarity): all pairs of different names, one of each side, whose similarity (of their bare forms: labels without the
    words of companies' forms) is ``least`` or more. Null names take no part; names without a bare form are alike.

    ``least`` is above 0. The similarity is that of ``special.name_similarity``, left name first; it isn't symmetric.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    sides = [df.select(F.col(df.columns[0]).alias("name")).filter("name is not null").distinct().withColumn("bare", special.bare_name(F.col("name"))) for df in (left, right)]
    filed = [_filed(s.select("bare").distinct(), least) for s in sides]
    often = filed[0].select("kind", "token").unionByName(filed[1].select("kind", "token")).groupBy("kind", "token").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("bare", "kind").orderBy("often", "token")  # a row a character
    a, b = (f.join(often, ["kind", "token"]).withColumn("nth", F.row_number().over(rarest)).filter("nth <= prefix").select("kind", "token", F.col("bare").alias(f"bare_{s}"), F.col("chars").alias(f"chars_{s}")) for f, s in zip(filed, "ab", strict=True))
    both = (F.length("bare_a") + F.length("bare_b")) * (least / 2) - _LITTLE  # characters that must match
    near = (F.length("bare_a") >= both) & (F.length("bare_b") >= both)
    shared = F.size(F.array_intersect("chars_a", "chars_b"))
    met = a.join(b, ["kind", "token"]).filter(near).filter(shared >= both).select("bare_a", "bare_b").distinct()
    alike = met.withColumn("similarity", special.matched_ratio(F.col("bare_a"), F.col("bare_b"))).filter(F.col("similarity") >= least)
    got = alike.join(sides[0].select(F.col("name").alias("left_name"), F.col("bare").alias("bare_a")), "bare_a")
    return got.join(sides[1].select(F.col("name").alias("right_name"), F.col("bare").alias("bare_b")), "bare_b").select("left_name", "right_name", "similarity")


def best_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """For each name of the left side with an alike one on the right: (left_name, right_name, similarity, margin), the likest (of equal ones the first by name) and by how much it leads, null if it is alone."""
    w = Window.partitionBy("left_name").orderBy(F.desc("similarity"), "right_name")
    ranked = similar_names(left, right, least).withColumn("margin", F.col("similarity") - F.lead("similarity").over(w)).withColumn("nth", F.row_number().over(w))
    return ranked.filter("nth = 1").drop("nth")
