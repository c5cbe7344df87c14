"""The join of names against all pairs, by difflib."""

import random
from difflib import SequenceMatcher

import pytest

from tidemark.functions.special import COMMON_WORDS
from tidemark.operators import names


def made(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "alphabet", "beta", "gamma", "Co", "Ltd", "delta", "group", "groupe", "AT&T", "of", "x", "ab", "aab", "Übung", "plc"]
    out = [None, "", "Inc", "a", "b", "aa", "ab", "ba", "The Company"]
    for _ in range(n):
        name = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.6:
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice("xyz ab") + name[i + rng.randrange(2) :]
        out.append(name)
    return out + out[:40]


def bare(name):
    import re

    x = re.sub("[‐-―]", "-", name.strip().lower().replace("&", "and"))
    return " ".join(w for w in re.sub("[^a-z0-9%]+", " ", x).split() if w not in COMMON_WORDS)


@pytest.mark.parametrize("least", [0.95, 0.8, 0.7, 0.55, 0.2])
def test_same_as_all_pairs(spark, least):
    left, right = made(1, 150), made(2, 120)
    df = lambda some: spark.createDataFrame([(x,) for x in some], "name string").repartition(4)
    got = {(r["left_name"], r["right_name"]): r["similarity"] for r in names.similar_names(df(left), df(right), least).collect()}
    all_ = {(a, b): SequenceMatcher(None, bare(a), bare(b)).ratio() for a in left if a is not None for b in right if b is not None}
    assert got == {k: v for k, v in all_.items() if v >= least}
    assert 20 < len(got) < len(all_)
    if least == 0.8:
        best = {r["left_name"]: (r["right_name"], r["similarity"]) for r in names.best_matches(df(left), df(right), least).collect()}
        assert best == {a: min(((b, s) for (x, b), s in got.items() if x == a), key=lambda m: (-m[1], m[0])) for a, _ in got}


def test_candidates_are_few(spark):
    """Names that share only what all share are not met."""
    import string

    rng = random.Random(3)
    some = ["common words here " + "".join(rng.choice(string.ascii_lowercase) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in some], "name string")
    assert names.similar_names(df, df, 0.9).count() == 300
    filed = names._filed(df.selectExpr("name bare"), 0.9).filter("kind = 'p'").groupBy("bare").agg({"prefix": "max", "token": "count"}).first()
    assert filed["max(prefix)"] <= filed["count(token)"] / 2


def test_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    assert names.similar_names(none, none, 0.8).count() == 0
    with pytest.raises(ValueError, match="least"):
        names.similar_names(none, none, 0.0)
