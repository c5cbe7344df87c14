"""The audit against applying the filters in each order, document by document."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import LONG
from tidemark.llm import filter_audit

GOOD = " ".join(f"word{i}" for i in range(220))
ROWS = [
    (1, GOOD, "a"), (2, GOOD, "a"), (2, GOOD, "a"), (3, GOOD, "b"), (4, None, None), (5, "", ""), (6, "SHOUT $ " * 150, "b"), (7, LONG, "c"), (8, LONG + " #", "c"), (None, GOOD, "a"), (None, "alone", "a"),
    (9, "ÄÖÜ" * 300, "a"), (10, "na " * 300, "b"), (11, "na " * 300, None), (12, " \t\n", "c"), (0, GOOD, "z"), (13, "A" * 3 + "x" * 97, "z"), (14, "A" * 2 + "x" * 98, "z"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (6, 0, 1), (9, None, 1), (99, 1, 1), (None, 1, 1), (10, 1, None), (10, 1, None)]


def failures(i, t, letters):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    every = {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
        "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in ROWS),
    }
    return {c for c in letters if every[c]}


def slow(letters):
    good, toxic = {i for i, q, _ in LABELS if q == 1}, {i for i, _, x in LABELS if x == 1}
    out, by_filter = {}, Counter()
    for order in permutations(letters):
        for step, f in enumerate(order, 1):
            for part in {p or "" for *_, p in ROWS}:
                got = Counter()
                for i, t, p in ROWS:
                    if (p or "") != part:
                        continue
                    bad = failures(i, t, letters)
                    gone = bool(bad & set(order[: step - 1]))
                    removed = f in bad and not gone
                    got += Counter(kept=not gone and f not in bad, removed=removed, redundant=f in bad and gone, unique_fails=bad == {f}, good_lost=removed and i is not None and i in good, toxic_lost=removed and i is not None and i in toxic)
                out[part, "".join(order), step] = got
                by_filter[part, f] += got["removed"]
    return {k: (*(v[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("letters", ["ABCDE", "EDA", "CB", "E"])
def test_same_as_applying_them(spark, letters):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], "doc_id long, text string, source string, mask string, n int, part string").repartition(3)
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    got = filter_audit.audit(docs, {c: filter_audit.FILTERS[c] for c in letters}, labels, flags)
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()}
    assert rows == slow(letters)


def test_of_nothing_and_bounds(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), {})
    orders, made = filter_audit.incidence("ABCDE")
    assert len(orders) == 120 and all(m.shape == (32, 600) for m in made.values())
