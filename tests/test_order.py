"""Places, running sums, quantiles and scores against NumPy, with one group, heavy ties, nulls and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import order

SCHEMA = "id long, g string, x double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal(3000), np.full(2000, 0.25), 10.0 ** rng.uniform(-200, 200, 500)])
    return [(int(i), [None, "a", "b"][i % 7 % 3], None if i % 50 == 0 else float(v)) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def test_places_of_any_type_with_ties_and_nulls(table, rows):
    got = {r["id"]: r["nth"] for r in order.places(table, F.desc("x"), "g").collect()}
    assert sorted(got.values()) == list(range(len(rows)))
    by = {r[0]: r for r in rows}
    seen = sorted(got, key=got.get)
    key = lambda i: (by[i][2] is None, -(by[i][2] or 0), by[i][1] is not None, by[i][1] or "")
    assert [key(i) for i in seen] == sorted(key(i) for i in seen)


def test_no_window_holds_the_table(table):
    """After the sort by ranges, places come from counts: the only window is over a row a range."""
    plan = order.places(table, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "Window [coalesce" not in plan
    above = plan[: plan.index("Window ")]
    assert "LogicalRDD" in above  # the rows themselves are not below the window
    assert "sum(" in plan


def test_folds_and_running_sums(spark, table, rows):
    sizes = sorted((r["fold"], r["count"]) for r in order.folds(table, "id", n=7).groupBy("fold").count().collect())
    assert [s for _, s in sizes] == [len(p) for p in np.array_split(np.arange(len(rows)), 7)]
    small = spark.createDataFrame([(i, "k", float(i % 5) if i % 4 else None) for i in range(100)], SCHEMA).repartition(5)
    got = {r["id"]: r["so_far"] for r in order.running_sums(small, "id", sums={"so_far": "x"}).collect()}
    assert [got[i] for i in range(100)] == list(np.cumsum([i % 5 if i % 4 else 0.0 for i in range(100)]))
    empty = spark.createDataFrame([], SCHEMA)
    assert order.places(empty, "x").count() == order.running_sums(empty, "x", sums={"s": "x"}).count() == order.folds(empty, "x", n=3).count() == 0


LEVELS = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)


@pytest.mark.parametrize("accuracy", [10_000, 20])  # a poor sketch only makes the ranges larger
def test_quantiles(spark, table, rows, accuracy):
    def expected(some):
        v = np.array([r[2] for r in some if r[2] is not None])
        return len(v), np.quantile(v, LEVELS)

    (whole,) = order.quantiles(table, [], "x", LEVELS, accuracy).collect()
    n, q = expected(rows)
    assert whole["n"] == n and np.allclose(whole["q"], q, rtol=1e-12)
    got = {r["g"]: r for r in order.quantiles(table, ["g"], "x", LEVELS, accuracy).collect()}
    assert set(got) == {None, "a", "b"}
    for g, r in got.items():
        n, q = expected([x for x in rows if x[1] == g])
        assert r["n"] == n and np.allclose(r["q"], q, rtol=1e-12)


def test_quantiles_of_nothing(spark):
    nulls = spark.createDataFrame([(1, "a", None), (2, "b", 3.0)], SCHEMA)
    got = {r["g"]: (r["n"], r["q"]) for r in order.quantiles(nulls, ["g"], "x", [0.5]).collect()}
    assert got == {"a": (0, [None]), "b": (1, [3.0])}
    assert order.quantiles(spark.createDataFrame([], SCHEMA), ["g"], "x", [0.5]).count() == 0


def test_quantiles_hold_no_group(table):
    """No aggregate whose buffer grows with the rows; windows are within a value range."""
    plan = order.quantiles(table, [], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "median(" not in plan and "collect_" not in plan


def test_crps_of_one_large_group(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal(20_000), 2)
    df = spark.createDataFrame([(float(v), 0.3) for v in x] + [(None, 0.3)], "x double, y double").repartition(8)
    (got,) = order.crps(df, [], "x", "y").collect()
    s, n = np.sort(x), len(x)
    assert np.isclose(got["crps"], np.abs(x - 0.3).mean() - ((2 * np.arange(1, n + 1) - n - 1) * s).sum() / n**2, rtol=1e-10)


def test_crps_by_group_is_the_mean_over_pairs(spark, rows):
    some = [(g, x) for _, g, x in rows[:400]]
    df = spark.createDataFrame(some, "g string, x double").withColumn("y", F.lit(0.1))
    got = {r["g"]: r["crps"] for r in order.crps(df, ["g"], "x", "y").collect()}
    for g in (None, "a", "b"):
        v = np.array([x for h, x in some if h == g and x is not None])
        assert np.isclose(got[g], np.abs(v - 0.1).mean() - np.abs(v[:, None] - v[None]).mean() / 2, rtol=1e-9)


def test_a_group_of_ten_million_samples(spark):
    """In ranges: the largest holds a small share of the group."""
    df = spark.range(10_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)).alias("x"), F.lit(0.5).alias("y"))
    _, _, ranges = order.value_ranges(df, [], "x", [i / order.RANGES for i in range(1, order.RANGES)])
    assert ranges.agg(F.max("size_")).first()[0] < 100_000
    assert abs(order.crps(df, [], "x", "y").first()["crps"] - (0.25 - 1 / 6)) < 1e-3
