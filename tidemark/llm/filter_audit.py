"""How filters interact: what each removes in every order in which they could be applied, and what it costs in good and toxic documents.

Texts are read once, into a mask of the filters that each document fails. All that the orders need of a part of the corpus is its histogram of masks
(2 ** k counts for k filters), and one such histogram for each label. These histograms are stacked as rows of a matrix; for each kind of outcome an integer incidence
matrix of 2 ** k by k! * k says which masks count at which step of which order, so that the outcomes are products of the two. Only histograms reach the products: a row a part, dealt over tasks.

1. A copy's failure is a question to the whole table (is there an equal text with a smaller id?). It is answered on counts: rows are added up by text digest, part and
   mask, with the counts of the smallest id beside them, so that a text of a third of all rows is a few rows for each task before it is shuffled.
2. Labels are joined by id; rows without an id are dealt out by their text, as they can't meet any.

Defined results: a null text is an empty one; a null part is the empty string; a null id is smaller than no other, and no id is smaller than it, so that it never fails as a copy; rows of equal id and text are no copies of
each other; labels of an id that has several count if one of them holds; a null outcome of a filter is no failure; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD

MOST_FILTERS = 7  # 7! orders of 7 steps are 35,280 rows a part
SALTS = 1024  # for rows without an id
COUNTS = ("kept", "removed", "redundant", "unique_fails")


def few_words(text: Column, least: int = 200) -> Column:
    return F.regexp_count(text, F.lit(WORD)) < least


def few_distinct_words(text: Column, percent: int = 50) -> Column:
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(text: Column, percent: int = 2) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.length(text)


def has_symbols(text: Column, symbols: str = "[#$%&*|]") -> Column:
    return text.rlike(symbols)


def copy_of_another(text: Column) -> None:
    """Marks the filter that looks at the whole table: an equal text with a smaller id."""


#: By letter: from the text's column to the failure, or ``copy_of_another``.
FILTERS = {"A": few_words, "B": few_distinct_words, "C": many_capitals, "D": has_symbols, "E": copy_of_another}


@lru_cache(maxsize=2)
def incidence(letters: str) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders of the filters, and for each count the matrix of masks by (order, step): 1 where a document of that mask counts. The bit of the n-th letter is 1 << n."""
    k = len(letters)
    orders = list(permutations(range(k)))
    mask = np.arange(1 << k)[:, None]
    bit = 1 << np.array(orders).reshape(-1)  # of the filter at each (order, step)
    earlier = (np.cumsum(1 << np.array(orders), axis=1) - (1 << np.array(orders))).reshape(-1)
    fails, gone = (mask & bit) > 0, (mask & earlier) > 0
    hits = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit}
    made = {name: m.astype(np.int64) for name, m in hits.items()}
    # What a filter removes in all orders, whatever its step: the same for each (order, step) that it stands at.
    by_filter = np.stack([made["removed"][:, bit == 1 << f].sum(axis=1) for f in range(k)], axis=1)
    made["shapley"] = by_filter[:, np.array(orders).reshape(-1)]
    return ["".join(letters[i] for i in o) for o in orders], made


def _products(letters: str, labels: list[str]):
    k = len(letters)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders, matrix = incidence(letters)
        width = len(orders) * k
        for pdf in batches:
            for at in range(0, len(pdf), 64):  # 64 parts make 64 * width rows
                some = pdf.iloc[at : at + 64]
                rows = {c: np.stack(some[c].to_list()).astype(np.int64) for c in ("n", *labels)}
                out = {c: (rows["n"] @ matrix[c]).reshape(-1) for c in (*COUNTS, "shapley")}
                out |= {f"{c}_lost": (rows[c] @ matrix["removed"]).reshape(-1) for c in labels}
                m = len(some)
                yield pd.DataFrame({"part": np.repeat(some["part"].to_numpy(), width), "filter_order": np.tile(np.repeat(orders, k), m), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * m)} | out)

    return step


def histograms(docs: DataFrame, filters: Mapping[str, object], labels: DataFrame | None, flags: Mapping[str, Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, one count for each flag): how many documents of each part have each mask."""
    letters = list(filters)
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_text = [F.coalesce(filters[c](F.col("t")), F.lit(False)).cast("int") * (1 << n) for n, c in enumerate(letters) if filters[c] is not copy_of_another]
    copy = next((1 << n for n, c in enumerate(letters) if filters[c] is copy_of_another), 0)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), reduce(lambda a, b: a + b, of_text, F.lit(0)).alias("mask"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(F.lit(0)))
    if labels is not None:
        held = labels.groupBy(F.col(id_col).alias("lid"), F.lit(0).cast("long").alias("lsalt")).agg(*(F.max(F.coalesce(flag, F.lit(False)).cast("long")).alias(c) for c, flag in flags.items()))
        rows = rows.join(held, (F.col("id") == F.col("lid")) & (F.col("salt") == F.col("lsalt")), "left").drop("lid", "lsalt")
    counts = ["n", *flags]
    some = [F.lit(1).cast("long").alias("n"), *((F.coalesce(F.col(c), F.lit(0)) if labels is not None else F.lit(0)).cast("long").alias(c) for c in flags)]
    sums = lambda: (F.sum(c).cast("long").alias(c) for c in counts)
    if not copy:
        return rows.select("part", "mask", *some).groupBy("part", "mask").agg(*sums())
    each = rows.select("id", "salt", "part", "digest", "mask", *some).groupBy("id", "salt", "digest", "part", "mask").agg(*sums())
    named, nameless = F.col("id").isNotNull(), [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_") for c in counts]
    groups = each.groupBy("digest", "part", "mask").agg(*sums(), *nameless, F.min(F.when(named, F.struct("id", *counts))).alias("first"))
    first = F.min("first.id").over(Window.partitionBy("digest"))  # a row a part and mask of a text
    passes = lambda c: F.col(f"{c}_") + F.coalesce(F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")), F.lit(0))
    both = groups.withColumn("least", first).select(
        "part", F.explode(F.array(F.struct(F.col("mask"), *(passes(c).alias(c) for c in counts)), F.struct((F.col("mask") + copy).alias("mask"), *((F.col(c) - passes(c)).alias(c) for c in counts)))).alias("h")
    )
    return both.select("part", "h.*").groupBy("part", "mask").agg(*sums())


def audit(docs: DataFrame, filters: Mapping[str, object] = FILTERS, labels: DataFrame | None = None, flags: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, each order of the filters and each step: kept, removed, redundant, unique_fails, shapley, and for each flag of ``labels`` (a condition on its columns, by
    name) how many such documents are removed here, ``<name>_lost``.

    ``filters``: by letter, a function from the text's column to whether it fails, or ``copy_of_another``.
    """
    letters, flags = "".join(filters), dict(flags or {})
    if not 1 <= len(letters) <= MOST_FILTERS or len(letters) != len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters of one letter each")
    got = histograms(docs, filters, labels, flags, id_col, text_col, part_col)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", *flags))))  # 2 ** k entries at most
    vector = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1)), lambda m: F.coalesce(F.element_at("h", m)[c], F.lit(0))).alias(c)
    stacked = got.groupBy("part").agg(by_mask.alias("h")).select("part", *(vector(c) for c in ("n", *flags)))
    columns = ", ".join(f"{c} long" for c in (*COUNTS, "shapley", *(f"{c}_lost" for c in flags)))
    return stacked.mapInPandas(_products(letters, list(flags)), f"part string, filter_order string, step int, {columns}")
