"""Queries over factor models and what follows from them (L-, R-02, R-03, R-19)."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import factors as L
from tidemark.operators import calendar, order, panel, stats
from tidemark.plans import fixtures as X
from tidemark.plans.registry import Tables, query
from tidemark.session import keep

END = datetime.date(1999, 12, 31)
r6 = lambda c, n=6: F.round(c, n)


def _panel(t: Tables) -> DataFrame:
    """(week, key, x) of all securities: wide, with many cells missing."""
    return X.returns(t).select("week", F.col("security_id").alias("key"), F.col("log_return").alias("x")).filter("x is not null").persist()


def _model(t: Tables, rank: int = 3) -> tuple[DataFrame, dict]:
    p = _panel(t)
    panel = L.Panel(p)
    return p, L.fit(panel, rank, sum(w <= END for w in panel.weeks))


@query("l02_imputed_panel")
def l02(t: Tables) -> DataFrame:
    """L-01, L-02: the panel's cells that are observed and that are filled, by week, with the sum of squares of what they are filled with."""
    p, m = _model(t)
    return L.filled_weeks(p, m).select("week", "observed", "filled", r6("norm", 4).alias("norm"))


@query("l06_pca_model")
def l06(t: Tables) -> DataFrame:
    """L-01, L-02, L-03, L-06."""
    _, m = _model(t)
    return t.spark.createDataFrame([(i + 1, round(float(s), 6), round(float(e), 6)) for i, (s, e) in enumerate(zip(m["singular"], m["share"], strict=True))], "factor int, singular double, share double")


@query("l03_truncated_svd")
def l03(t: Tables) -> DataFrame:
    """L-03: singular values by a random range finder, without a matrix of weeks by weeks, and the share of each."""
    panel = L.Panel(_panel(t))
    m = L.fit(panel, 3, sum(w <= END for w in panel.weeks), rounds=1, solver="random")
    return t.spark.createDataFrame([(i + 1, round(float(s), 6), round(float(e), 6)) for i, (s, e) in enumerate(zip(m["singular"], m["share"], strict=True))], "factor int, singular double, share double")


@query("l04_masked_scores")
def l04(t: Tables) -> DataFrame:
    p, m = _model(t)
    return L.scores(p, m, least=0.0).withColumn("score", r6("score"))


@query("l05_residual_scales")
def l05(t: Tables) -> DataFrame:
    p, m = _model(t)
    return L.residual_scales(p, m, L.scores(p, m, least=0.0), END).select("key", r6("residual_scale").alias("residual_scale"))


@query("l07_rank_cv")
def l07(t: Tables) -> DataFrame:
    """L-07, A-08, A-19: errors by rank, of held-out weeks of held-out securities and of forecasts, and the rank that the one-error rule takes."""
    p = _panel(t)
    weeks = p.select("week").distinct().count()
    bounds = [b for b in calendar.fold_bounds(weeks, 3, 180) if b[0] > 0]
    folds = L.RankSelection(p, [1, 2, 3, 4], bounds, 3)
    g = stats.mean_and_error(folds.errors(), ["rank"], "mse").select("rank", F.col("mean").alias("g"), F.col("error").alias("ge"))
    f = stats.mean_and_error(folds.forecasts(least=0.0), ["rank"], "forecast_mse").select("rank", F.col("mean").alias("f"), F.col("error").alias("fe"))
    both = g.join(f, "rank").persist()
    chosen = stats.one_error_rule(both, "rank", "g", "ge", "f", "fe")
    return both.crossJoin(F.broadcast(chosen)).select("rank", r6("g").alias("mse"), r6("ge").alias("error"), r6("f").alias("forecast"), r6("fe").alias("forecast_error"), (F.col("rank") == F.col("selected")).alias("selected"))


@query("l08_shuffled_folds", "WITH k AS (SELECT s_suppkey, md5('52:' || s_suppkey) AS h FROM supplier) SELECT s_suppkey, CAST(ntile(5) OVER (ORDER BY h, s_suppkey) AS INTEGER) AS fold FROM k")
def l08(t: Tables) -> DataFrame:
    k = t.supplier.select("s_suppkey", F.md5(F.concat(F.lit("52:"), F.col("s_suppkey").cast("string")).cast("binary")).alias("h"))
    return order.folds(k, "h", "s_suppkey", n=5).select("s_suppkey", F.col("fold").cast("int").alias("fold"))


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_A = [["a11", "a12", "a13"], ["a12", "a22", "a23"], ["a13", "a23", "a33"]]
_B = ["b1", "b2", "b3"]
_SOLVED = ", ".join(f"{_det([[_B[i] if j == k else _A[i][j] for j in range(3)] for i in range(3)])} / {_det(_A)} AS c{k + 1}" for k in range(3))
#: Normal equations of centred lags with 1 on the diagonal, solved by Cramer's rule.
_RIDGE = f"WITH {X.BK}, s AS (SELECT week, basket_return AS y, lag(basket_return, 1) OVER o AS l1, lag(basket_return, 2) OVER o AS l2, lag(basket_return, 3) OVER o AS l3 FROM bk WHERE basket_return IS NOT NULL WINDOW o AS (ORDER BY week)), d AS (SELECT * FROM s WHERE l3 IS NOT NULL), f AS (SELECT avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, avg(l3) AS m3, " + ", ".join(f"count(*) * covar_pop(l{i}, l{j}){' + 1' if i == j else ''} AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j) + ", " + ", ".join(f"count(*) * covar_pop(l{i}, y) AS b{i}" for i in (1, 2, 3)) + f" FROM d WHERE week <= DATE '1999-12-31'), c AS (SELECT *, {_SOLVED} FROM f) SELECT week, round(my + c1 * (l1 - m1) + c2 * (l2 - m2) + c3 * (l3 - m3), 6) AS forecast, round(pow(y - (my + c1 * (l1 - m1) + c2 * (l2 - m2) + c3 * (l3 - m3)), 2), 6) AS squared_error FROM d, c WHERE week > DATE '1999-12-31'"


@query("l09_ridge_forecast", _RIDGE)
def l09(t: Tables) -> DataFrame:
    """Ridge on three lags: by the engine's own solver, with the penalty on the scale that it expects."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    w = Window.orderBy("week")
    b = X.basket(t).filter("basket_return is not null").select("week", F.col("basket_return").alias("y"), *(F.lag("basket_return", k).over(w).alias(f"l{k}") for k in (1, 2, 3))).dropna()
    b = keep(b)  # a row a week, made once for all that reads it
    train = VectorAssembler(inputCols=["l1", "l2", "l3"], outputCol="v").transform(b)
    fit = train.filter(F.col("week") <= F.lit(END))
    n, sd = fit.agg(F.count("*"), F.stddev_pop("y")).first()
    m = LinearRegression(featuresCol="v", labelCol="y", solver="normal", standardization=False, elasticNetParam=0.0, regParam=1.0 * sd / n).fit(fit)
    return m.transform(train.filter(F.col("week") > F.lit(END))).select("week", r6("prediction").alias("forecast"), r6(F.pow(F.col("y") - F.col("prediction"), 2)).alias("squared_error"))


def _var(t: Tables):
    p, m = _model(t)
    s = L.scores(p, m, least=0.0).groupBy("week").pivot("factor", [1, 2, 3]).agg(F.first("score")).orderBy("week").dropna().toPandas()  # a row a week
    series = s[["1", "2", "3"]].to_numpy(float)
    return m, series, L.stable_var(series[[w <= END for w in s["week"]]], 2)


@query("l10_stable_var")
def l10(t: Tables) -> DataFrame:
    """L-10, L-11."""
    _, _, v = _var(t)
    rows = [(i + 1, j + 1, round(float(c), 6)) for i, r in enumerate(v["coefficients"]) for j, c in enumerate(r)]
    return t.spark.createDataFrame(rows, "equation int, term int, coefficient double").withColumn("radius", F.lit(round(v["radius"], 6)))


@query("r03_factor_rollout")
def r03(t: Tables) -> DataFrame:
    """R-02, R-03, R-19, L-13, L-14, W-02: factor paths, projected to a market index."""
    m, series, v = _var(t)
    paths = L.rollout(t.spark, v, series, 100, 26)
    base, loadings = L.projection(m)
    table = t.spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(loadings)], "factor long, loading double")
    market = paths.join(F.broadcast(table), "factor").groupBy("path", "step").agg((F.sum(F.col("value") * F.col("loading")) + base).alias("r"))
    level = panel.level(F.col("r"), Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return market.select("path", "step", r6("r").alias("weekly_return"), r6(level).alias("index_value"))


@query("l18_scenarios")
def l18(t: Tables) -> DataFrame:
    """L-18, L-19, over each user's path: how it ends, how it shakes, how far it falls."""
    p = panel.drawdown(X.user_paths(t), ["user_id"], "step", "level")
    f = p.groupBy("user_id").agg((F.max_by("level", "step") - 1).alias("total"), (F.stddev_pop("r") * F.sqrt(F.lit(52.0))).alias("volatility"), F.min("drawdown").alias("fall"))
    s = L.scenarios(f, ["total", "volatility", "fall"], "user_id", 4)
    n = f.agg(F.count("*").alias("n"))
    both = s.join(f, "user_id")
    long = both.unpivot("scenario", ["total", "volatility", "fall"], "feature", "x")
    middles = order.quantiles(long, ["scenario", "feature"], "x", [0.5]).groupBy("scenario").pivot("feature", ["total", "volatility", "fall"]).agg(r6(F.first(F.col("q")[0])))
    middles = middles.toDF("scenario", "median_total", "median_volatility", "median_fall")
    got = both.groupBy("scenario").agg(F.count("*").alias("paths"), F.max(F.when(F.col("medoid"), F.col("user_id"))).alias("representative")).join(middles, "scenario")
    return got.crossJoin(F.broadcast(n)).select("scenario", r6(F.col("paths") / F.col("n")).alias("probability"), "paths", "median_total", "median_volatility", "median_fall", "representative")


@query("l14_market_projection", f"WITH {X.RT}, {X.EN}, s AS (SELECT week, sector, avg(log_return) AS f FROM rt JOIN en USING (security_id) GROUP BY 1, 2), l AS (SELECT sector, sum(s_acctbal) / (SELECT sum(s_acctbal) FROM en) AS loading FROM en GROUP BY 1) SELECT week, round(sum(f * loading), 6) AS market_return FROM s JOIN l USING (sector) WHERE f IS NOT NULL GROUP BY 1")
def l14(t: Tables) -> DataFrame:
    e = X.entities(t)
    total = e.agg(F.sum("s_acctbal").alias("total"))
    loading = e.groupBy("sector").agg(F.sum("s_acctbal").alias("b")).crossJoin(total).select("sector", (F.col("b") / F.col("total")).alias("loading"))
    s = X.returns(t).join(e.select("security_id", "sector"), "security_id").groupBy("week", "sector").agg(F.avg("log_return").alias("f")).filter("f is not null")
    return s.join(F.broadcast(loading), "sector").groupBy("week").agg(r6(F.sum(F.col("f") * F.col("loading"))).alias("market_return"))


@query("l13_projection_statistics", f"WITH {X.RT}, {X.EN}, m AS (SELECT security_id, avg(log_return) AS mu, stddev_samp(log_return) AS sd FROM rt GROUP BY 1) SELECT sector, round(avg(mu), 8) AS intercept, round(avg(sd), 8) AS loading FROM m JOIN en USING (security_id) GROUP BY 1")
def l13(t: Tables) -> DataFrame:
    m = X.returns(t).groupBy("security_id").agg(F.avg("log_return").alias("mu"), F.stddev_samp("log_return").alias("sd"))
    return m.join(X.entities(t).select("security_id", "sector"), "security_id").groupBy("sector").agg(r6(F.avg("mu"), 8).alias("intercept"), r6(F.avg("sd"), 8).alias("loading"))


@query("l17_scale_grid", "WITH g AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5]) AS s), n AS (SELECT s, avg(ln(s * 100) + 0.5 * pow((value - 50) / (s * 100), 2)) AS nll FROM events, g GROUP BY 1) SELECT CAST(s AS DOUBLE) AS scale, round(nll, 6) AS nll, nll = (SELECT min(nll) FROM n) AS best FROM n")
def l17(t: Tables) -> DataFrame:
    """The scale of a grid with the least negative log-likelihood: one scan, a column a scale."""
    grid = (0.5, 0.75, 1.0, 1.25, 1.5)
    cost = lambda s: F.avg(F.lit(float(np.log(s * 100))) + 0.5 * F.pow((F.col("value") - 50) / (s * 100), 2))
    row = t.events.agg(F.array(*(F.struct(F.lit(s).alias("scale"), cost(s).alias("nll")) for s in grid)).alias("g"))
    best = F.array_min(F.transform("g", lambda x: x["nll"]))
    return row.select(F.explode("g").alias("x"), best.alias("least")).select("x.scale", r6("x.nll").alias("nll"), (F.col("x.nll") == F.col("least")).alias("best"))


_W17 = """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, value) AS i FROM events),
w AS (SELECT user_id, i, ms, value, CASE WHEN value > 100 THEN 1 ELSE 0 END AS mode, ms AS opened, value AS peak, CAST(1 AS BIGINT) AS n, false AS done FROM s WHERE i = 1
UNION ALL SELECT s.user_id, s.i, s.ms, s.value,
  CASE w.mode WHEN 0 THEN CASE WHEN s.value > 100 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN s.ms >= w.opened + 3600000 THEN 2 ELSE 1 END ELSE CASE WHEN s.value <= 25 THEN 0 ELSE 2 END END,
  CASE WHEN w.mode = 1 THEN w.opened ELSE s.ms END, CASE WHEN w.mode = 1 THEN greatest(w.peak, s.value) ELSE s.value END, CASE WHEN w.mode = 1 THEN w.n + 1 ELSE 1 END, w.mode = 1 AND s.ms >= w.opened + 3600000
  FROM w JOIN s ON s.user_id = w.user_id AND s.i = w.i + 1)
SELECT CAST(user_id AS BIGINT) AS key, opened, peak, n AS samples FROM w WHERE done"""


@query("w17_debounced_captures", _W17)
def w17(t: Tables) -> DataFrame:
    """W-17, X-02, X-03."""
    from tidemark.streaming import debounce

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return debounce.captures(t.events.select("user_id", ms.alias("ms"), "value"), "user_id", "ms", "value", 100, 25, 3_600_000)
