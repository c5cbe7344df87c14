"""Queries over statistics (A-, M-, W-11, W-13, W-16, P-15, P-16, X-)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import order, stats
from tidemark.plans import fixtures as X
from tidemark.plans.registry import Tables, query

r6 = lambda c, n=6: F.round(c, n)
LV = ", ".join(map(str, stats.LEVELS))
NAMES = ["q025", "q10", "q25", "q50", "q75", "q90", "q975"]


@query("a01_group_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def a01(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("a02_group_sum_null_group", "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a02(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")).agg(r6(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"))


@query("a03_numeric_means", "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def a03(t: Tables) -> DataFrame:
    li = t.lineitem.drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.groupBy("l_returnflag").agg(*(r6(F.avg(c)).alias(c) for c, k in li.dtypes if k == "double"))


@query("a04_mean_and_deviation", "SELECT user_id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS deviation, count(v) AS n FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1")
def a04(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return e.groupBy("user_id").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("deviation"), F.count("v").alias("n"))


@query("a06_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a06(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("a07_fraction_true", "SELECT event_type, round(coalesce(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 6) AS fraction FROM events GROUP BY 1")
def a07(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(r6(F.coalesce(F.avg((F.col("value") > 50).cast("double")), F.lit(0.0))).alias("fraction"))


MSE_SQL = "m AS (SELECT l_linenumber AS rank, avg(l_discount) AS g, CASE WHEN count(l_discount) > 1 THEN stddev_samp(l_discount) / sqrt(count(l_discount)) ELSE 0 END AS ge, avg(l_tax) AS f, CASE WHEN count(l_tax) > 1 THEN stddev_samp(l_tax) / sqrt(count(l_tax)) ELSE 0 END AS fe FROM lineitem GROUP BY 1)"


def _cv(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_linenumber").alias("rank"), "l_discount", "l_tax")
    g = stats.mean_and_error(li, ["rank"], "l_discount").select("rank", F.col("mean").alias("g"), F.col("error").alias("ge"))
    return g.join(stats.mean_and_error(li, ["rank"], "l_tax").select("rank", F.col("mean").alias("f"), F.col("error").alias("fe")), "rank")


@query("a08_mean_and_error", f"WITH {MSE_SQL} SELECT rank, round(g, 8) AS mean, round(ge, 8) AS error FROM m")
def a08(t: Tables) -> DataFrame:
    return _cv(t).select("rank", r6("g", 8).alias("mean"), r6("ge", 8).alias("error"))


@query("a13_quantile_fan", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {v}), 6) AS {n}" for v, n in zip(stats.LEVELS, NAMES, strict=True)) + " FROM events GROUP BY 1")
def a13(t: Tables) -> DataFrame:
    q = order.quantiles(t.events, ["event_type"], "value", stats.LEVELS)
    return q.select("event_type", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(NAMES)))


@query("a14_empirical_cdf", "SELECT event_type, round(avg(CASE WHEN value <= 42.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS percentile FROM events GROUP BY 1")
def a14(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(r6(F.avg((F.col("value") <= 42.5).cast("double"))).alias("percentile"))


@query("a15_crps", "WITH s AS (SELECT user_id, value AS x, 50.0::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(avg(abs(x - y)) - sum((2 * i - n - 1) * x) / (max(n) * CAST(max(n) AS DOUBLE)), 6) AS crps FROM s GROUP BY 1")
def a15(t: Tables) -> DataFrame:
    s = t.events.select("user_id", F.col("value").alias("x"), F.lit(50.0).alias("y"))
    return order.crps(s, ["user_id"], "x", "y").select("user_id", r6("crps").alias("crps"))


@query("a16_interval_coverage", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.1) AS c, quantile_cont(value, 0.9) AS d FROM events GROUP BY 1), k AS (SELECT event_type, avg(CASE WHEN value BETWEEN a AND b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c50, avg(CASE WHEN value BETWEEN c AND d THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c80, avg(d - c) AS width FROM events JOIN q USING (event_type) GROUP BY 1) SELECT event_type, round(c50, 6) AS coverage_50, round(c80, 6) AS coverage_80, round(width, 6) AS mean_width, round((abs(c50 - 0.5::DOUBLE) + abs(c80 - 0.8::DOUBLE)) / 2, 6) AS calibration_error FROM k")
def a16(t: Tables) -> DataFrame:
    q = order.quantiles(t.events, ["event_type"], "value", (0.25, 0.75, 0.1, 0.9)).drop("n")
    hit = lambda i, j: F.avg(F.col("value").between(F.col("q")[i], F.col("q")[j]).cast("double"))
    k = t.events.join(q, "event_type").groupBy("event_type").agg(hit(0, 1).alias("c50"), hit(2, 3).alias("c80"), F.avg(F.col("q")[3] - F.col("q")[2]).alias("width"))
    return k.select("event_type", r6("c50").alias("coverage_50"), r6("c80").alias("coverage_80"), r6("width").alias("mean_width"), r6((F.abs(F.col("c50") - 0.5) + F.abs(F.col("c80") - 0.8)) / 2).alias("calibration_error"))


@query("a17_errors", "SELECT event_type, round(avg(abs(value - 50)), 6) AS mae, round(avg(pow(value - 50, 2)), 4) AS mse, round(avg(pow(value - 50, 2)) / var_samp(value), 6) AS standardised FROM events GROUP BY 1")
def a17(t: Tables) -> DataFrame:
    d = F.col("value") - 50
    return t.events.groupBy("event_type").agg(r6(F.avg(F.abs(d))).alias("mae"), r6(F.avg(d * d), 4).alias("mse"), r6(F.avg(d * d) / F.var_samp("value")).alias("standardised"))


@query("a18_arg_extremes", "SELECT event_type, (SELECT event_id FROM events x WHERE x.event_type = e.event_type ORDER BY value, event_id LIMIT 1) AS at_least, (SELECT event_id FROM events x WHERE x.event_type = e.event_type ORDER BY value DESC, event_id LIMIT 1) AS at_most FROM (SELECT DISTINCT event_type FROM events) e")
def a18(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("at_least"), F.max_by("event_id", F.struct(F.col("value"), (-F.col("event_id")).alias("b"))).alias("at_most"))


@query("a19_one_error_rule", f"WITH {MSE_SQL}, p AS (SELECT * FROM m WHERE g <= (SELECT g + ge FROM m ORDER BY g, rank LIMIT 1)) SELECT min(rank) AS selected FROM p WHERE f <= (SELECT f + fe FROM p ORDER BY f, rank LIMIT 1)")
def a19(t: Tables) -> DataFrame:
    return stats.one_error_rule(_cv(t), "rank", "g", "ge", "f", "fe")


@query("a20_uncertainty_ladder", f"WITH {X.UP} SELECT step, round(quantile_cont(level, 0.1), 6) AS q10, round(quantile_cont(level, 0.5), 6) AS q50, round(quantile_cont(level, 0.9), 6) AS q90, round(avg(CASE WHEN level < 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS loss FROM up WHERE step IN (1, 4, 13, 26, 40) GROUP BY 1")
def a20(t: Tables) -> DataFrame:
    p = X.user_paths(t).filter(F.col("step").isin(1, 4, 13, 26, 40)).select(F.col("step").cast("long").alias("step"), "level")
    loss = p.groupBy("step").agg(F.avg((F.col("level") < 1).cast("double")).alias("loss"))
    g = order.quantiles(p, ["step"], "level", (0.1, 0.5, 0.9)).join(loss, "step")
    return g.select("step", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90"))), r6("loss").alias("loss"))


@query("a21_scorecard", "WITH m AS (SELECT event_type AS method, round(avg(abs(value - 50)), 6) AS mae, round(stddev_samp(value), 6) AS spread, round(avg(CASE WHEN value BETWEEN 20 AND 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM events GROUP BY 1), u AS (SELECT method, unnest(['mae', 'spread', 'coverage']) AS metric, unnest([mae, spread, coverage]) AS v FROM m) SELECT method, metric, v, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'coverage' THEN -v ELSE v END) AS place FROM u")
def a21(t: Tables) -> DataFrame:
    m = t.events.groupBy(F.col("event_type").alias("method")).agg(r6(F.avg(F.abs(F.col("value") - 50))).alias("mae"), r6(F.stddev_samp("value")).alias("spread"), r6(F.avg(F.col("value").between(20, 80).cast("double"))).alias("coverage"))
    u = m.unpivot("method", ["mae", "spread", "coverage"], "metric", "v")
    w = Window.partitionBy("metric").orderBy(F.when(F.col("metric") == "coverage", -F.col("v")).otherwise(F.col("v")))
    return u.withColumn("place", F.rank().over(w).cast("long"))


@query("a22_cumulative_share", "WITH g AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, round(sum(q) OVER (ORDER BY q DESC, l_suppkey ROWS UNBOUNDED PRECEDING) / sum(q) OVER (), 6) AS share FROM g")
def a22(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    total = g.agg(F.sum("q").alias("total"))
    so_far = order.running_sums(g, F.desc("q"), "l_suppkey", sums={"so_far": "q"})
    return so_far.crossJoin(F.broadcast(total)).select("l_suppkey", r6(F.col("so_far") / F.col("total")).alias("share"))  # by one row


FAN_SQL = f"WITH {X.UP}, f AS (SELECT step, quantile_cont(level, 0.25) AS a, quantile_cont(level, 0.5) AS m, quantile_cont(level, 0.75) AS b, min(CASE WHEN user_id = 0 THEN level END) AS actual FROM up GROUP BY 1)"


def _fan(t: Tables) -> DataFrame:
    p = X.user_paths(t).select(F.col("step").cast("long").alias("step"), "user_id", "level")
    actual = p.filter("user_id = 0").select("step", F.col("level").alias("actual"))
    g = order.quantiles(p, ["step"], "level", (0.25, 0.5, 0.75)).join(actual, "step", "left")
    return g.select("step", F.col("q")[0].alias("a"), F.col("q")[1].alias("m"), F.col("q")[2].alias("b"), "actual")


@query("a23_notional_gap", FAN_SQL + " SELECT step, round(100000 * m, 2) AS notional, round(100000 * (actual - m), 2) AS gap FROM f")
def a23(t: Tables) -> DataFrame:
    return _fan(t).select("step", r6(100000 * F.col("m"), 2).alias("notional"), r6(100000 * (F.col("actual") - F.col("m")), 2).alias("gap"))


@query("a24_error_series", FAN_SQL + " SELECT step, round(actual - m, 6) AS error, actual >= a AND actual <= b AS inside FROM f WHERE actual IS NOT NULL")
def a24(t: Tables) -> DataFrame:
    return _fan(t).filter("actual is not null").select("step", r6(F.col("actual") - F.col("m")).alias("error"), F.col("actual").between(F.col("a"), F.col("b")).alias("inside"))


@query("a34_fan_with_origin", FAN_SQL + " SELECT 0 AS step, 1.0::DOUBLE AS lower, 1.0::DOUBLE AS median, 1.0::DOUBLE AS upper UNION ALL SELECT step, round(a, 6), round(m, 6), round(b, 6) FROM f")
def a34(t: Tables) -> DataFrame:
    f = _fan(t).select("step", r6("a").alias("lower"), r6("m").alias("median"), r6("b").alias("upper"))
    return t.spark.createDataFrame([(0, 1.0, 1.0, 1.0)], f.schema).unionByName(f)


@query("a27_simulation_sanity", f"WITH {X.UP}, e AS (SELECT user_id, arg_max(level, step) AS x, max(step) AS h FROM up GROUP BY 1) SELECT round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(CASE WHEN x < 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS loss, round(median(exp(ln(x) * 52 / h) - 1), 6) AS annualised, array_to_string(list_filter([CASE WHEN max(x) > 2 THEN 'extreme_gain' END, CASE WHEN min(x) < 0.5 THEN 'extreme_loss' END, CASE WHEN count(*) < 100 THEN 'few_paths' END], lambda w: w IS NOT NULL), ',') AS warnings FROM e")
def a27(t: Tables) -> DataFrame:
    e = X.user_paths(t).groupBy("user_id").agg(F.max_by("level", "step").alias("x"), F.max("step").alias("h"))
    e = e.withColumn("yearly", F.exp(F.ln("x") * 52 / F.col("h")) - 1)
    middle = order.quantiles(e, [], "yearly", [0.5]).select(r6(F.col("q")[0]).alias("annualised"))
    warn = F.array_compact(F.array(F.when(F.max("x") > 2, "extreme_gain"), F.when(F.min("x") < 0.5, "extreme_loss"), F.when(F.count("*") < 100, "few_paths")))
    got = e.agg(r6(F.min("x")).alias("least"), r6(F.max("x")).alias("most"), r6(F.avg((F.col("x") < 1).cast("double"))).alias("loss"), F.array_join(warn, ",").alias("warnings"))
    return got.crossJoin(middle)  # of one row each


@query("a28_histogram", "WITH b AS (SELECT CAST(least(floor((value - 0) / 10), 49) AS BIGINT) AS bin FROM events) SELECT bin, count(*) AS n, round(count(*) / (10 * CAST((SELECT count(*) FROM events) AS DOUBLE)), 8) AS density FROM b GROUP BY 1")
def a28(t: Tables) -> DataFrame:
    n = t.events.agg(F.count("*").alias("all"))
    h = t.events.groupBy(F.least(F.width_bucket("value", F.lit(0.0), F.lit(500.0), F.lit(50)) - 1, F.lit(49)).alias("bin")).agg(F.count("*").alias("n"))
    return h.crossJoin(F.broadcast(n)).select("bin", "n", r6(F.col("n") / (10 * F.col("all").cast("double")), 8).alias("density"))  # by one row


@query("a35_path_axis", f"WITH {X.UP}, e AS (SELECT user_id % 3 AS method, user_id, arg_max(level, step) AS x FROM up GROUP BY 1, 2) SELECT method, round(median(x), 6) AS median_terminal, round((SELECT quantile_cont(x, 0.002) FROM e), 6) AS low, round((SELECT quantile_cont(x, 0.998) FROM e), 6) AS high FROM e GROUP BY 1")
def a35(t: Tables) -> DataFrame:
    e = X.user_paths(t).groupBy((F.col("user_id") % 3).alias("method"), "user_id").agg(F.max_by("level", "step").alias("x"))
    axis = order.quantiles(e, [], "x", (0.002, 0.998)).drop("n")
    middle = order.quantiles(e, ["method"], "x", [0.5]).select("method", r6(F.col("q")[0]).alias("median_terminal"))
    return middle.crossJoin(F.broadcast(axis)).select("method", "median_terminal", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


@query("a36_selection_curve", f"WITH {MSE_SQL} SELECT rank, round(f - fe, 8) AS lower, round(f, 8) AS mean, round(f + fe, 8) AS upper, rank = (SELECT rank FROM m ORDER BY f, rank LIMIT 1) AS best FROM m")
def a36(t: Tables) -> DataFrame:
    m = _cv(t)
    best = m.agg(F.min_by("rank", F.struct("f", "rank")).alias("b"))
    return m.crossJoin(F.broadcast(best)).select("rank", r6(F.col("f") - F.col("fe"), 8).alias("lower"), r6("f", 8).alias("mean"), r6(F.col("f") + F.col("fe"), 8).alias("upper"), (F.col("rank") == F.col("b")).alias("best"))


@query("a37_training_history", "WITH h AS (SELECT o_orderstatus AS phase, o_custkey % 10 AS epoch, avg(o_totalprice) AS train, CASE WHEN o_orderstatus <> 'P' THEN avg(o_totalprice * 1.01::DOUBLE) END AS validation FROM orders GROUP BY 1, 2) SELECT phase, (SELECT epoch FROM h x WHERE x.phase = h.phase ORDER BY coalesce(validation, train), epoch LIMIT 1) AS selected, count(*) AS epochs FROM h GROUP BY 1, 2")
def a37(t: Tables) -> DataFrame:
    h = t.orders.groupBy(F.col("o_orderstatus").alias("phase"), (F.col("o_custkey") % 10).alias("epoch")).agg(F.avg("o_totalprice").alias("train"), F.avg(F.col("o_totalprice") * 1.01).alias("v"))
    loss = F.coalesce(F.when(F.col("phase") != "P", F.col("v")), F.col("train"))
    return h.groupBy("phase").agg(F.min_by("epoch", F.struct(loss.alias("l"), "epoch")).alias("selected"), F.count("*").alias("epochs"))


@query("a39_mean_of_batches", "WITH b AS (SELECT floor((row_number() OVER (ORDER BY event_id) - 1) / 32) AS batch, value FROM events) SELECT round(avg(m), 6) AS loss FROM (SELECT avg(value) AS m FROM b GROUP BY batch)")
def a39(t: Tables) -> DataFrame:
    """Batches of 32 in the order of ids, over all rows: places come from counts of id ranges, so no task numbers more than a range."""
    b = order.places(t.events.select("event_id", "value"), "event_id").select(F.floor(F.col("nth") / 32).alias("batch"), "value")
    return b.groupBy("batch").agg(F.avg("value").alias("m")).agg(r6(F.avg("m")).alias("loss"))


@query("a32_capture_peak", "WITH s AS (SELECT user_id, CAST(floor(epoch_ms(ts) / 3600000) AS BIGINT) AS hour, value FROM events) SELECT user_id, hour, max(value) AS peak FROM s GROUP BY 1, 2 HAVING max(value) > 50")
def a32(t: Tables) -> DataFrame:
    hour = F.floor(X.epoch_ms(F.col("ts")) / 3600000)
    return t.events.groupBy("user_id", hour.alias("hour")).agg(F.max("value").alias("peak")).filter("peak > 50")


@query("a33_sound_direction", "WITH v AS (SELECT user_id % 50 AS g, sum(CASE WHEN user_id % 50 = 49 THEN 0 ELSE value * sin(radians(event_id % 5 * 72 - 108)) END) AS y, sum(CASE WHEN user_id % 50 IN (48, 49) THEN 0 ELSE value * cos(radians(event_id % 5 * 72 - 108)) END) AS x FROM events GROUP BY 1), a AS (SELECT g, CASE WHEN abs(x) < 0.001 THEN CASE WHEN y > 0 THEN 90.0::DOUBLE WHEN y < 0 THEN -90.0::DOUBLE ELSE 0.0::DOUBLE END ELSE degrees(atan2(y, x)) END + 180 AS a FROM v) SELECT g, CAST(trunc(CASE WHEN a > 180 THEN a - 360 ELSE a END) AS INTEGER) AS direction FROM a")
def a33(t: Tables) -> DataFrame:
    """Loudness-weighted unit vectors of five microphones 72 degrees apart, the angle of their sum turned by half. Straight up or down is 90 or -90, no sound 0, before the turn."""
    at, g = F.radians((F.col("event_id") % 5 * 72 - 108).cast("double")), F.col("user_id") % 50
    y, x = F.when(g == 49, 0.0).otherwise(F.col("value") * F.sin(at)), F.when(g.isin(48, 49), 0.0).otherwise(F.col("value") * F.cos(at))
    v = t.events.groupBy(g.alias("g")).agg(F.sum(y).alias("y"), F.sum(x).alias("x"))
    return v.select("g", stats.direction_back(F.col("x"), F.col("y")).cast("int").alias("direction"))


@query("p15_point_in_box", "SELECT event_id, value BETWEEN 10 AND 100 AND user_id BETWEEN 5 AND 80 AS inclusive, value > 10 AND value < 100 AND user_id > 5 AND user_id < 80 AS strict FROM events")
def p15(t: Tables) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    return t.events.select("event_id", (v.between(10, 100) & u.between(5, 80)).alias("inclusive"), ((v > 10) & (v < 100) & (u > 5) & (u < 80)).alias("strict"))


@query("p16_threshold_bands", "SELECT event_id, CASE WHEN a > 45 THEN 30 WHEN a > 20 THEN 20 ELSE 10 END AS turn_speed, CASE WHEN a > 20 THEN 15 WHEN a > 10 THEN 10 WHEN a > 3 THEN 5 ELSE 0 END AS correction FROM (SELECT event_id, abs(CAST(trunc(value) AS INTEGER) - 50) AS a FROM events)")
def p16(t: Tables) -> DataFrame:
    """Bands of an angle become a chain of comparisons: no join, whatever the rows."""
    angle = F.abs(F.col("value").cast("int") - 50)
    return t.events.select("event_id", stats.banded(angle, stats.TURN_SPEED).alias("turn_speed"), stats.banded(angle, stats.HEADING_CORRECTION).alias("correction"))


@query("m02_annualise", f"WITH {X.UP} SELECT user_id, round(stddev_pop(r) * sqrt(52), 6) AS volatility, round(exp(sum(r)) - 1, 6) AS total FROM up GROUP BY 1")
def m02(t: Tables) -> DataFrame:
    return X.user_paths(t).groupBy("user_id").agg(r6(F.stddev_pop("r") * math.sqrt(52)).alias("volatility"), r6(F.expm1(F.sum("r"))).alias("total"))


@query("m03_wrap_angle", "SELECT event_id, a, a - 360 * ceil((a - 180) / 360) AS wrapped FROM (SELECT event_id, floor(value * 16) - 1000 AS a FROM events)")
def m03(t: Tables) -> DataFrame:
    a = t.events.select("event_id", (F.floor(F.col("value") * 16) - 1000).cast("double").alias("a"))
    return a.withColumn("wrapped", F.col("a") - 360 * F.ceil((F.col("a") - 180) / 360))


@query("m04_trigonometry", "SELECT event_id, round(sin(value), 9) AS s, round(cos(value), 9) AS c, round(degrees(atan(value)), 9) AS d FROM events")
def m04(t: Tables) -> DataFrame:
    return t.events.select("event_id", r6(F.sin("value"), 9).alias("s"), r6(F.cos("value"), 9).alias("c"), r6(F.degrees(F.atan("value")), 9).alias("d"))


@query("m05_warmup_cosine", f"WITH {X.UP}, k AS (SELECT user_id, step - 1 AS step, CAST(greatest(ceil(0.1::DOUBLE * n), 1) AS BIGINT) AS warm, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM up)) SELECT user_id, step, round(CASE WHEN step < warm THEN (step + 1) / CAST(warm AS DOUBLE) ELSE 0.5 * (1 + cos(pi() * (step - warm) / greatest(n - warm, 1))) END, 9) AS multiplier FROM k")
def m05(t: Tables) -> DataFrame:
    """A schedule a user, over as many steps as it has: linear for the first tenth, then a half cosine."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    k = X.user_paths(t).select("user_id", (F.col("step") - 1).cast("long").alias("step"), n.alias("n")).withColumn("warm", F.greatest(F.ceil(F.lit(0.1) * F.col("n")), F.lit(1)))
    s, warm = F.col("step"), F.col("warm")
    later = 0.5 * (1 + F.cos(math.pi * (s - warm) / F.greatest(F.col("n") - warm, F.lit(1))))
    return k.select("user_id", "step", r6(F.when(s < warm, (s + 1) / warm).otherwise(later), 9).alias("multiplier"))


@query("m06_bounds_and_softmax", "WITH m AS (SELECT user_id, avg(value) / 100 AS x FROM events GROUP BY 1) SELECT user_id, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(tanh(x), 9) AS bounded, round(exp(x) / sum(exp(x)) OVER (), 9) AS softmax FROM m")
def m06(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("x"))
    total = m.agg(F.sum(F.exp("x")).alias("total"))
    return m.crossJoin(F.broadcast(total)).select("user_id", r6(1 / (1 + F.exp(-F.col("x"))), 9).alias("sigmoid"), r6(F.tanh("x"), 9).alias("bounded"), r6(F.exp("x") / F.col("total"), 9).alias("softmax"))


@query("m07_student_t_density", "SELECT event_id, round(lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - (nu + 1) / 2 * ln(1 + x * x / nu), 8) AS log_density FROM (SELECT event_id, 5.0::DOUBLE AS nu, (value - 50) / 30 AS x FROM events)")
def m07(t: Tables) -> DataFrame:
    from tidemark.functions.special import student_t_log_density

    return t.events.select("event_id", r6(student_t_log_density((F.col("value") - 50) / 30, 5.0), 8).alias("log_density"))


@query("m08_target_heading", "WITH a AS (SELECT event_id, (value * 7) % 720 - 360 + user_id AS raw, value AS here FROM events), w AS (SELECT event_id, here, raw - here AS d FROM a) SELECT event_id, round(here + (d - 360 * ceil((d - 180) / 360)), 6) AS target FROM w")
def m08(t: Tables) -> DataFrame:
    d = (F.col("value") * 7) % 720 - 360 + F.col("user_id") - F.col("value")
    return t.events.select("event_id", r6(F.col("value") + (d - 360 * F.ceil((d - 180) / 360))).alias("target"))


_SERIES = f"WITH {X.BK}, s AS (SELECT row_number() OVER (ORDER BY week) AS pos, x - avg(x) OVER () AS d, count(*) OVER () AS n FROM (SELECT week, basket_return * basket_return AS x FROM bk WHERE basket_return IS NOT NULL))"
RHO_SQL = _SERIES + ", r AS (SELECT l.lag, any_value(a.n) AS n, sum(a.d * b.d) / (SELECT sum(d * d) FROM s) AS rho FROM (SELECT unnest(range(1, 27)) AS lag) l JOIN s a ON l.lag <= a.n // 4 JOIN s b ON b.pos = a.pos + l.lag GROUP BY 1)"


def _rho(t: Tables) -> DataFrame:
    """Of the activity, the squared return."""
    return stats.autocorrelation(X.basket(t).filter("basket_return is not null").select("week", (F.col("basket_return") * F.col("basket_return")).alias("x")), "week", "x", 26)


@query("w11_autocorrelation", RHO_SQL + " SELECT CAST(lag AS INTEGER) AS lag, round(rho, 6) AS rho FROM r")
def w11(t: Tables) -> DataFrame:
    return _rho(t).select("lag", r6("rho").alias("rho"))


@query("w11_block_length", RHO_SQL + ", k AS (SELECT lag, sum(CASE WHEN abs(rho) < 1.96 / sqrt(n) THEN 1 ELSE 0 END) OVER (ORDER BY lag ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS weak FROM r) SELECT CAST(greatest(2, coalesce(min(CASE WHEN weak = 3 THEN lag END) - 2, max(lag))) AS INTEGER) AS block FROM k")
def w11b(t: Tables) -> DataFrame:
    return stats.block_length(_rho(t))


@query("w13_quantile_paths", f"WITH {X.UP}, e AS (SELECT user_id, arg_max(level, step) AS x FROM up GROUP BY 1), o AS (SELECT user_id, x, row_number() OVER (ORDER BY x, user_id) - 1 AS pos, count(*) OVER () AS n FROM e) SELECT k.i AS nth, user_id, round(x, 6) AS terminal FROM o JOIN (SELECT unnest(range(0, 9)) AS i) k ON pos = CAST(round_even(k.i * (n - 1) / 8.0::DOUBLE, 0) AS BIGINT)")
def w13(t: Tables) -> DataFrame:
    """Paths spread evenly over the order of their ends: places rounded half to even, as by linspace."""
    e = X.user_paths(t).groupBy("user_id").agg(F.max_by("level", "step").alias("x"))
    o = order.places(e, "x", "user_id", name="pos")
    n = e.agg(F.count("*").alias("n"))
    k = t.spark.range(9).crossJoin(n).select(F.col("id").alias("nth"), F.bround(F.col("id") * (F.col("n") - 1) / 8, 0).cast("int").alias("pos"))
    return o.join(F.broadcast(k), "pos").select("nth", "user_id", r6("x").alias("terminal"))


@query("w16_threshold_toggle", "SELECT event_id, user_id, CAST(sum(CASE WHEN value > 75 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 2 AS INTEGER) AS state FROM events")
def w16(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", "user_id", (F.sum((F.col("value") > 75).cast("int")).over(w) % 2).cast("int").alias("state"))


@query("x01_first_trigger", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 100 GROUP BY 1")
def x01(t: Tables) -> DataFrame:
    return t.events.filter("value > 100").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("x04_fixed_period_samples", "WITH s AS (SELECT user_id, epoch_ms(ts) AS ms, value, event_id FROM events), a AS (SELECT user_id, min(ms) AS t0 FROM s GROUP BY 1), b AS (SELECT s.user_id, CAST(floor((ms - t0 - 5400000) / 3600000.0::DOUBLE) AS BIGINT) AS slot, ms, event_id, value FROM s JOIN a USING (user_id)) SELECT user_id, slot, arg_max(CASE WHEN value >= 20 THEN 1 ELSE 0 END, (ms, event_id)) AS bit FROM b WHERE slot BETWEEN 0 AND 42 GROUP BY 1, 2")
def x04(t: Tables) -> DataFrame:
    """43 slots of an hour from one and a half hours after the start; each holds its last sample."""
    s = t.events.select("user_id", X.epoch_ms(F.col("ts")).alias("ms"), "value", "event_id")
    a = s.groupBy("user_id").agg(F.min("ms").alias("t0"))
    b = s.join(a, "user_id").withColumn("slot", F.floor((F.col("ms") - F.col("t0") - 5400000) / 3600000)).filter(F.col("slot").between(0, 42))
    return b.groupBy("user_id", "slot").agg(F.max_by((F.col("value") >= 20).cast("int"), F.struct("ms", "event_id")).alias("bit"))
