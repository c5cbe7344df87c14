"""Rolling evaluation and backtests against NumPy refits, with gaps, short series, ties and what lies after an origin changed."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.operators.stats import LEVELS

WEEKS = [datetime.date(2001, 1, 5) + datetime.timedelta(7 * i) for i in range(160)]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    out = {}
    for key in ("a", "b", "short"):
        x = np.zeros(160)
        for t in range(2, 160):
            x[t] = 0.01 + 0.5 * x[t - 1] - 0.2 * x[t - 2] + 0.05 * rng.standard_normal()
        x[rng.random(160) < 0.05] = np.nan
        out[key] = x[:40] if key == "short" else x
    out["b"][100:] = 0.25  # flat from here on
    return out


def table(spark, series):
    rows = [(k, WEEKS[i], None if np.isnan(v) else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, week date, r double").repartition(3)


def refit(y, lags, ridge):
    """Of the rows of a lookback (value, lags): intercept, coefficients and deviation."""
    x, v = y[:, 1:], y[:, 0]
    mx, my = x.mean(axis=0), v.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + ridge * np.eye(lags), (x - mx).T @ (v - my))
    return my - mx @ b, b, np.sqrt(((v - my - (x - mx) @ b) ** 2).mean() + 1e-8)


@pytest.mark.parametrize("lags", [1, 2, 3])
def test_sliding_normal_equations(spark, series, lags):
    length, ridge = 30, 1e-6
    rows = evaluate.lookbacks(table(spark, series), "key", "week", "r", length, lags).withColumn("m", evaluate.autoregression(F.col("sums"), lags, ridge, most=10.0)).collect()
    seen = 0
    for key, x in series.items():
        at = [i for i in range(len(x)) if np.isfinite(x[i])]
        v = x[at]
        got = {r["week"]: r for r in rows if r["key"] == key}
        assert len(got) == len(v)
        for t in range(len(v)):
            r = got[WEEKS[at[t]]]
            assert r["past"] == pytest.approx(v[max(0, t - length) : t].tolist())
            assert (r["recent"] is None) == (t < lags) and (t < lags or r["recent"] == pytest.approx(v[t - lags : t][::-1].tolist()))
            usable = range(max(lags, t - length), t)
            if len(usable) < lags + 2:
                assert r["m"]["sd"] is None
                continue
            a, b, sd = refit(np.array([[v[u], *v[u - lags : u][::-1]] for u in usable]), lags, ridge)
            assert r["m"]["intercept"] == pytest.approx(a, abs=1e-6) and r["m"]["coefficients"] == pytest.approx(b.tolist(), abs=1e-5) and r["m"]["sd"] == pytest.approx(sd, abs=1e-6)
            seen += 1
    assert seen > 200


def test_unstable_models_are_shrunk(spark):
    growing = {"g": 1.2 ** np.arange(30)}
    m = evaluate.lookbacks(table(spark, growing), "key", "week", "r", 30, 1).withColumn("m", evaluate.autoregression(F.col("sums"), 1)).orderBy(F.desc("week")).first()["m"]
    assert 0.9 < m["radius"] <= 0.98


def test_rolling_scores(spark, series):
    got = evaluate.rolling(table(spark, series), "key", "week", "r", "2002-06-01", 52, 26, 2, samples=30).collect()
    assert {r["method"] for r in got} == {"zero_return", "block_bootstrap", "gaussian", "student_t", "linear"} and {r["key"] for r in got} == {"a", "b"}
    zero = next(r for r in got if r["method"] == "zero_return")
    assert zero["q"] == [0.0] * 7 and zero["crps"] == pytest.approx(abs(zero["actual"]))
    flat = [r for r in got if r["key"] == "b" and r["week"] == WEEKS[159] and r["method"] == "block_bootstrap"]
    assert all(r["q"] == pytest.approx([0.25] * 7) and r["crps"] == pytest.approx(0) and r["percentile"] == 1 for r in flat)
    s = {r["method"]: r for r in evaluate.summary(evaluate.rolling(table(spark, {"a": series["a"]}), "key", "week", "r", "2002-06-01", 104, 26, 2, samples=60)).collect()}
    assert s["linear"]["crps"] < s["gaussian"]["crps"] < s["zero_return"]["crps"] * 1.05
    assert 0.6 < s["linear"]["coverage_80"] <= 1


def test_scores_of_known_samples(spark):
    rng = np.random.default_rng(1)
    s, y = rng.standard_normal(25).round(1), 0.3
    (got,) = evaluate.scored(spark.createDataFrame([(1, s.tolist(), y)], "k int, s array<double>, y double"), "s", "y").collect()
    assert got["q"] == pytest.approx(np.quantile(s, LEVELS).tolist()) and got["percentile"] == pytest.approx((s <= y).mean())
    assert got["crps"] == pytest.approx(np.abs(s - y).mean() - np.abs(s[:, None] - s[None]).mean() / 2)


def test_one_shuffle_whatever_the_methods(spark, series):
    plan = evaluate.rolling(table(spark, series), "key", "week", "r", "2002-06-01", samples=500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_interval_join_is_the_product_with_a_filter(spark):
    rng = np.random.default_rng(2)
    day = lambda n: datetime.date(1999, 12, 1) + datetime.timedelta(int(n))
    points, spans = [(i, day(n)) for i, n in enumerate(rng.integers(0, 400, 200))], [(i, day(a), day(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 380, 60), rng.integers(-3, 120, 60), strict=True))]
    got = evaluate.interval_join(spark.createDataFrame(points, "p int, at date"), "at", spark.createDataFrame(spans, "s int, after date, until date"), "after", "until", 30)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if a < x <= b)


def test_origins_see_only_what_lies_before(spark, series):
    origins = spark.createDataFrame([(datetime.date(2002, 7, 1),), (datetime.date(2003, 1, 3),), (datetime.date(2001, 1, 5),)], "origin date")
    args = {"horizons": (1, 4), "weeks": 60, "least": 30, "samples": 20}
    fits = lambda s: {(r["origin"], r["key"]): tuple(r) for r in evaluate.origin_fits(table(spark, s), "key", "week", "r", origins, 60, 30).collect()}
    before = fits(series)
    later = {k: np.where([w >= datetime.date(2002, 7, 1) for w in WEEKS[: len(x)]], 99.0, x) for k, x in series.items()}
    after = fits(later)
    first = [k for k in before if k[0] == datetime.date(2002, 7, 1)]
    assert first and all(before[k][:3] == after[k][:3] and before[k][3:5] == pytest.approx(after[k][3:5]) for k in first)
    assert (datetime.date(2001, 1, 5), "a") not in before and {before[k][-1] for k in before if k[1] == "short"} <= {"too_little_history"}
    x = series["a"][[w < datetime.date(2002, 7, 1) and w >= datetime.date(2002, 7, 1) - datetime.timedelta(420) for w in WEEKS]]
    got = before[datetime.date(2002, 7, 1), "a"]
    assert got[2:4] == pytest.approx((np.isfinite(x).sum(), np.nanmean(x)))
    rows = evaluate.backtest(table(spark, series), "key", "week", "r", origins, **args).collect()
    assert {r["method"] for r in rows} == {"zero_return", "gaussian"}
    for r in rows:
        ahead = [series[r["key"]][i] for i, w in enumerate(WEEKS) if 0 <= (w - r["origin"]).days < 7 * r["horizon"]]
        assert len(ahead) == r["horizon"] and r["actual"] == pytest.approx(sum(ahead))


def test_of_nothing(spark):
    none = spark.createDataFrame([], "key string, week date, r double")
    assert evaluate.rolling(none, "key", "week", "r", "2002-06-01").count() == 0
    assert evaluate.backtest(none, "key", "week", "r", spark.createDataFrame([], "origin date"), (1, 2)).count() == 0
