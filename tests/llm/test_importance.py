"""Importance resampling against a plain computation, with nulls, ties, repeated rows, empty and long texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tests.llm.test_operators import LONG
from tidemark.llm import importance

TEXTS = [
    (1, "Alpha beta GAMMA delta " * 8), (2, "alpha beta gamma delta " * 8), (2, "alpha beta gamma delta " * 8), (3, None), (4, ""), (5, LONG), (6, "Übermut tut SELTEN gut, ÄÖÜ äöü 123 x_y " * 5),
    (7, "one two three"), (None, "no id but enough words " * 6), (8, "été 中文\U0001f600 KK İI " * 7), (9, "{}~ \x7f !!!"), (10, "target words are here " * 10), (11, "target words are here " * 9), (12, "z " * 25),
]
TARGET = ["target words are here", None, "", "and here are more target words"]
SCHEMA = "doc_id long, text string, n_words string, buckets int, score int, nth int"


def grams(text, low, high):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def slow(rows, target, percent, least, low, high, buckets, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    docs = [(i, *grams(t, low, high)) for i, t in rows]
    s, t = Counter(bucket(g) for *_, gs in docs for g in gs), Counter(bucket(g) for x in target for g in grams(x, low, high)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, gs in docs:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(open_) * percent // 100
    return [(*r, n + 1 if n < drawn else None) for n, r in enumerate(open_)] + [(*r, None) for r in out if r[1] < least]


order = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("args", [(50, 20, 1, 1, 10_000, 2024), (100, 1, 1, 3, 50, 7), (10, 20, 2, 2, 1000, 1), (0, 0, 1, 1, 10, 1)])
def test_same_as_plain(spark, args):
    percent, least, low, high, buckets, seed = args
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in TEXTS], SCHEMA).repartition(4)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(docs, target, percent, least, low, high, buckets, seed).select("id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(slow(TEXTS, TARGET, *args), key=order)


def test_of_nothing(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).count() == 0
    some = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = [tuple(r) for r in importance.resample(some, target).select("id", "n_words", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=order) == sorted(slow(TEXTS, [], 10, 20, 1, 1, 10_000, 2024), key=order)


def test_scoring_explodes_and_joins_nothing(spark):
    """Behind the table of buckets, a score is one pass: the gains are a constant in it."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = importance.hashed(docs, "text", 1, 1, 100, id="doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan and "PythonUDF" not in plan
