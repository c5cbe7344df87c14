"""Queries over calendars, panels, currencies and eligibility (T-, W-, A-09 to A-12, L-01, L-12, L-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import calendar, panel
from tidemark.plans import fixtures as X
from tidemark.plans.registry import Tables, query

TRAIN_END = "1999-12-31"
r6 = lambda c, n=6: F.round(c, n)


@query("weekly_basket", f"WITH {X.BK}, c AS (SELECT *, exp(least(greatest(sum(coalesce(basket_return, 0)) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING), -80.0::DOUBLE), 80.0::DOUBLE)) AS lvl FROM bk), d AS (SELECT *, greatest(1.0::DOUBLE, max(lvl) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING)) AS pk FROM c) SELECT week, round(basket_return, 6) AS basket_return, round(observed_fraction, 6) AS observed_fraction, round(lvl, 6) AS index_level, round(lvl / pk - 1, 6) AS drawdown FROM d")
def weekly_basket(t: Tables) -> DataFrame:
    """T-02, T-03, W-01, A-09, A-10, W-02, W-03: the flagship, from prices to the basket's drawdown."""
    b = X.basket(t).withColumn("all", F.lit(0))
    w = Window.partitionBy("all").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)  # one row a week
    lv = b.withColumn("lvl", panel.level(F.coalesce("basket_return", F.lit(0).cast("double")), w))
    d = panel.drawdown(lv, ["all"], "week", "lvl")
    return d.select("week", r6("basket_return").alias("basket_return"), r6("observed_fraction").alias("observed_fraction"), r6("lvl").alias("index_level"), r6("drawdown").alias("drawdown"))


@query("t02_weekly_last_price", f"WITH {X.WK} SELECT security_id, week, round(price, 9) AS price FROM wk")
def t02(t: Tables) -> DataFrame:
    return X.weekly(t).select("security_id", "week", r6("price", 9).alias("price"))


@query("t02_daily_event_last", "SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS last_value, count(*) AS n FROM events GROUP BY 1, 2")
def daily_event_last(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", "event_id").alias("last_value"), F.count("*").alias("n"))


@query("t03_week_calendar", f"WITH {X.SP} SELECT week, CAST(row_number() OVER (ORDER BY week) AS INTEGER) AS n FROM cal")
def t03(t: Tables) -> DataFrame:
    return calendar.weeks_between(X.weekly(t)).withColumn("n", F.row_number().over(Window.orderBy("week")))


@query("t01_parse_timestamps", "SELECT event_id, CAST(ts AS TIMESTAMP) AS stamp, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS day FROM events")
def t01(t: Tables) -> DataFrame:
    s = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", F.col("ts").alias("stamp"), s.try_cast("date").alias("day"))


@query("t04_inclusive_slice", f"WITH {X.WK} SELECT week, count(*) AS n FROM wk WHERE week >= DATE '1997-01-03' AND week <= DATE '{TRAIN_END}' GROUP BY week")
def t04(t: Tables) -> DataFrame:
    return X.weekly(t).filter(F.col("week").between(F.lit("1997-01-03").cast("date"), F.lit(TRAIN_END).cast("date"))).groupBy("week").agg(F.count("*").alias("n"))


@query("t05_open_closed_period", f"WITH {X.WK} SELECT security_id, count(*) AS n FROM wk WHERE week > DATE '{TRAIN_END}' AND week <= DATE '2000-06-30' GROUP BY security_id")
def t05(t: Tables) -> DataFrame:
    return calendar.between(X.weekly(t), "week", TRAIN_END, "2000-06-30").groupBy("security_id").agg(F.count("*").alias("n"))


@query("t06_date_arithmetic", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 10 AS d10, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS m3, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 YEAR AS DATE) AS y2 FROM orders")
def t06(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_sub(d, 10).alias("d10"), F.add_months(d, -3).alias("m3"), F.add_months(d, 24).alias("y2"))


@query("t07_completion_lag", f"WITH {X.WK} SELECT max(week) AS last_complete FROM wk WHERE week <= DATE '2001-06-30' - 3")
def t07(t: Tables) -> DataFrame:
    return X.weekly(t).filter(F.col("week") <= F.date_sub(F.lit("2001-06-30").cast("date"), 3)).agg(F.max("week").alias("last_complete"))


@query("t08_snapshot_date", "SELECT o_orderstatus AS status, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS snapshot FROM orders GROUP BY 1")
def t08(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.date_format(F.max(F.to_date("o_orderdate")), "yyyy-MM-dd").alias("snapshot"))


_SCALE = "CASE code WHEN '3-MEDIUM' THEN 0.01::DOUBLE WHEN '5-LOW' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END"
FX_SQL = f"WITH {X.FX}, o AS (SELECT code, week, CASE WHEN code <> '4-NOT SPECIFIED' AND (code <> '2-HIGH' OR week <= (SELECT min(week) FROM fx) + 70) THEN usd_per_unit END AS d, CASE WHEN code <> '4-NOT SPECIFIED' OR week <= (SELECT min(week) FROM fx) + 70 THEN CASE WHEN month(week) = 6 THEN 0.0::DOUBLE ELSE 1 / usd_per_unit END END AS i FROM fx), u AS (SELECT code, week, 'direct' AS direction, d * {_SCALE} AS usd FROM o WHERE d IS NOT NULL UNION ALL SELECT code, week, 'inverse', 1 / i * {_SCALE} FROM o WHERE i <> 0), n AS (SELECT code, min(direction) AS direction FROM (SELECT code, direction FROM u GROUP BY ALL HAVING count(*) >= 20) GROUP BY 1) SELECT code, week, direction, usd FROM u JOIN n USING (code, direction)"


@query("t09_fx_direction", FX_SQL)
def t09(t: Tables) -> DataFrame:
    """One currency has too few direct quotes and falls back, one has too few of either; some inverse quotes are 0. All values are compared unrounded."""
    fx = X.fx(t)
    early = F.col("week") <= F.date_add("first", 70)
    q = fx.crossJoin(F.broadcast(fx.agg(F.min("week").alias("first"))))  # by one row
    direct = F.when((F.col("code") != "4-NOT SPECIFIED") & ((F.col("code") != "2-HIGH") | early), F.col("usd_per_unit"))
    inverse = F.when((F.col("code") != "4-NOT SPECIFIED") | early, F.when(F.month("week") == 6, 0.0).otherwise(1 / F.col("usd_per_unit")))
    scale = F.when(F.col("code") == "3-MEDIUM", 0.01).when(F.col("code") == "5-LOW", 0.001).otherwise(1.0)
    return panel.usd_per_unit(q.select("code", "week", direct.alias("direct"), inverse.alias("inverse")), scale)


CODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
USD_SQL = f"WITH {X.SP}, {X.FX}, f0 AS (SELECT c.code, w.week, fx.usd_per_unit FROM (SELECT DISTINCT code FROM fx) c CROSS JOIN cal w LEFT JOIN fx USING (code, week)), f1 AS (SELECT code, week, last_value(usd_per_unit IGNORE NULLS) OVER (PARTITION BY code ORDER BY week ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS usd_per_unit FROM f0), j AS (SELECT p.security_id, p.week, p.price * f.usd_per_unit AS usd FROM pn p LEFT JOIN f1 f ON f.week = p.week AND f.code = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][p.security_id % 5 + 1]), l AS (SELECT *, lag(usd) OVER (PARTITION BY security_id ORDER BY week) AS before FROM j) SELECT security_id, week, round(CASE WHEN usd > 0 AND before > 0 THEN ln(usd / before) END, 6) AS usd_return FROM l"


@query("t10_usd_return", USD_SQL)
def t10(t: Tables) -> DataFrame:
    """T-10, J-05, W-05: rates on the prices' calendar, filled for at most 4 weeks, converted before the ratio is taken."""
    w = X.weekly(t)
    weeks = calendar.weeks_between(w)
    rates = X.fx(t)
    full = rates.select("code").distinct().crossJoin(F.broadcast(weeks)).join(rates, ["code", "week"], "left")  # five codes by a calendar
    rates = calendar.forward_fill(full, "code", "week", "usd_per_unit", 4)
    p = calendar.spine(w, "security_id").join(w, ["security_id", "week"], "left")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("security_id") % 5 + 1).cast("int"))
    usd = p.withColumn("code", code).join(rates, ["code", "week"], "left").withColumn("price", F.col("price") * F.col("usd_per_unit"))
    return panel.adjacent_log_return(usd).select("security_id", "week", r6("log_return").alias("usd_return"))


@query("w05_forward_fill", f"WITH {X.SP} SELECT security_id, week, round(last_value(price IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS price FROM pn")
def w05(t: Tables) -> DataFrame:
    w = X.weekly(t)
    full = calendar.spine(w, "security_id").join(w, ["security_id", "week"], "left")
    return calendar.forward_fill(full, "security_id", "week", "price", 2).select("security_id", "week", r6("price", 9).alias("price"))


_FOLDS = "n AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS pos, count(*) OVER () AS rows FROM cal), b AS (SELECT DISTINCT i AS fold, 180 + (rows - 180) * i // 3 AS train_end, 180 + (rows - 180) * (i + 1) // 3 AS held_end FROM n, unnest(range(0, 3)) u(i))"


@query("t11_expanding_folds", f"WITH {X.SP}, {_FOLDS} SELECT b.fold, CASE WHEN pos < b.train_end THEN 'train' ELSE 'held' END AS part, min(week) AS first_week, max(week) AS last_week, count(*) AS n FROM n JOIN b ON pos < b.held_end GROUP BY 1, 2")
def t11(t: Tables) -> DataFrame:
    f = calendar.expanding_folds(calendar.weeks_between(X.weekly(t)), "week", 3, 180)
    return f.groupBy("fold", "part").agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count("*").alias("n"))


@query("t12_fold_eligibility", f"WITH {X.RT}, {_FOLDS} SELECT b.fold, rt.security_id, count(rt.log_return) AS observed FROM rt JOIN n USING (week) JOIN b ON pos < b.train_end GROUP BY b.fold, rt.security_id, b.train_end HAVING count(rt.log_return) >= greatest(2, 26, ceil(0.25 * b.train_end))")
def t12(t: Tables) -> DataFrame:
    rt = X.returns(t)
    folds = calendar.expanding_folds(calendar.weeks_between(X.weekly(t)), "week", 3, 180).filter("part = 'train'").select("fold", "week", "train_end")
    seen = rt.filter("log_return is not null").join(F.broadcast(folds), "week").groupBy("fold", "security_id", "train_end").agg(F.count("*").alias("observed"))  # a row a fold and week
    return seen.filter(F.col("observed") >= F.greatest(F.lit(26), F.ceil(F.lit(0.25) * F.col("train_end")))).select("fold", "security_id", "observed")


@query("t13_requested_end", "SELECT least(max(CAST(l_shipdate AS DATE)), DATE '2001-06-30') AS requested_end, min(CAST(l_shipdate AS DATE)) < least(max(CAST(l_shipdate AS DATE)), DATE '2001-06-30') AS in_order FROM lineitem")
def t13(t: Tables) -> DataFrame:
    d = F.to_date("l_shipdate")
    end = F.least(F.max(d), F.lit("2001-06-30").cast("date"))
    return t.lineitem.agg(end.alias("requested_end"), (F.min(d) < end).alias("in_order"))


@query("t14_first_usable_series", "WITH s AS (SELECT l_suppkey AS security_id, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN l_extendedprice END AS adj_close, l_extendedprice + l_tax AS c FROM lineitem) SELECT security_id, round(sum(CASE WHEN n > 0 THEN adj_close ELSE c END), 2) AS total, count(CASE WHEN n > 0 THEN adj_close ELSE c END) AS used FROM (SELECT *, count(adj_close) OVER (PARTITION BY security_id) AS n FROM s) GROUP BY 1")
def t14(t: Tables) -> DataFrame:
    """The whole series comes from adj_close if it has any value, else from close."""
    s = t.lineitem.select(F.col("l_suppkey").alias("security_id"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_extendedprice")).alias("adj_close"), (F.col("l_extendedprice") + F.col("l_tax")).alias("close"))
    g = s.groupBy("security_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("adj_close", "close") for n, f in (("n", F.count), ("sum", F.sum))))
    pick = lambda x: F.when(F.col("adj_close_n") > 0, F.col(f"adj_close_{x}")).otherwise(F.col(f"close_{x}"))
    return g.select("security_id", r6(pick("sum"), 2).alias("total"), pick("n").alias("used"))


@query("m01_log_ratio", "SELECT event_id, CASE WHEN value - 20 > 0 AND user_id > 3 THEN round(ln((value - 20) / user_id), 9) END AS log_ratio FROM events")
def m01(t: Tables) -> DataFrame:
    """Null where either side is not positive."""
    return t.events.select("event_id", r6(panel.log_ratio(F.col("value") - 20, F.when(F.col("user_id") > 3, F.col("user_id"))), 9).alias("log_ratio"))


@query("w01_adjacent_log_return", f"WITH {X.RT} SELECT security_id, week, round(log_return, 6) AS log_return FROM rt")
def w01(t: Tables) -> DataFrame:
    return X.returns(t).select("security_id", "week", r6("log_return").alias("log_return"))


@query("w01_gap_audit", f"WITH {X.RT} SELECT security_id, count(price) AS priced, count(log_return) AS returned, CAST(sum(CASE WHEN price IS NOT NULL AND log_return IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unbridged FROM rt GROUP BY 1")
def gap_audit(t: Tables) -> DataFrame:
    return X.returns(t).groupBy("security_id").agg(F.count("price").alias("priced"), F.count("log_return").alias("returned"), F.count(F.when(F.col("price").isNotNull() & F.col("log_return").isNull(), 1)).alias("unbridged"))


@query("w02_cumulative_index", f"WITH {X.UP} SELECT user_id, step, round(level, 6) AS level FROM up")
def w02(t: Tables) -> DataFrame:
    return X.user_paths(t).select("user_id", F.col("step").cast("long").alias("step"), r6("level").alias("level"))


@query("w03_max_drawdown", f"WITH {X.UP} SELECT user_id, round(min(level / peak - 1), 6) AS max_drawdown FROM (SELECT *, greatest(1.0::DOUBLE, max(level) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING)) AS peak FROM up) GROUP BY 1")
def w03(t: Tables) -> DataFrame:
    return panel.drawdown(X.user_paths(t), ["user_id"], "step", "level").groupBy("user_id").agg(r6(F.min("drawdown")).alias("max_drawdown"))


@query("w04_recovery_fraction", f"WITH {X.UP} SELECT user_id, round(least(greatest((arg_max(level, step) - min(level)) / greatest(1 - min(level), 1e-8::DOUBLE), 0), 5), 6) AS recovery FROM up GROUP BY 1")
def w04(t: Tables) -> DataFrame:
    low = F.min("level")
    x = (F.max_by("level", "step") - low) / F.greatest(1 - low, F.lit(1e-8))
    return X.user_paths(t).groupBy("user_id").agg(r6(F.least(F.greatest(x, F.lit(0.0)), F.lit(5.0))).alias("recovery"))


@query("w15_life_and_coverage", f"WITH {X.RT}, l AS (SELECT security_id, min(week) AS a, max(week) AS b, count(*) AS n FROM rt WHERE log_return IS NOT NULL GROUP BY 1) SELECT security_id, a AS first_week, b AS last_week, n AS weeks, round(n / (CAST(b - a AS DOUBLE) / 7 + 1), 6) AS coverage FROM l")
def w15(t: Tables) -> DataFrame:
    g = X.returns(t).filter("log_return is not null").groupBy("security_id").agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count("*").alias("weeks"))
    return g.withColumn("coverage", r6(F.col("weeks") / (F.datediff("last_week", "first_week") / 7 + 1)))


EL_SQL = f"WITH {X.RT}, l AS (SELECT security_id, count(log_return) AS n, count(log_return) FILTER (WHERE week <= DATE '{TRAIN_END}') AS tn, min(week) FILTER (WHERE log_return IS NOT NULL AND week <= DATE '{TRAIN_END}') AS ta, max(week) FILTER (WHERE log_return IS NOT NULL AND week <= DATE '{TRAIN_END}') AS tb FROM rt GROUP BY 1), c AS (SELECT *, CASE WHEN tn > 0 THEN tn / (CAST(tb - ta AS DOUBLE) / 7 + 1) ELSE 0 END AS cov FROM l), e AS (SELECT *, CASE WHEN n < 52 THEN 'insufficient_pre_cutoff_weeks' WHEN tn < 104 THEN 'insufficient_training_weeks' WHEN cov < 0.66 THEN 'low_pre_cutoff_coverage' END AS reason FROM c)"


def eligible(t: Tables) -> DataFrame:
    return panel.eligibility(X.returns(t), TRAIN_END, 52, 104, 0.66)


@query("p12_exclusion_routing", EL_SQL + " SELECT security_id, reason, round(cov, 6) AS coverage FROM e")
def p12(t: Tables) -> DataFrame:
    return eligible(t).select("security_id", "reason", r6("coverage").alias("coverage"))


@query("a05_exclusion_counts", EL_SQL + " SELECT reason, count(*) AS n FROM e GROUP BY 1")
def a05(t: Tables) -> DataFrame:
    return eligible(t).groupBy("reason").agg(F.count("*").alias("n"))


@query("a09_weighted_basket", f"WITH {X.RT}, {X.EN} SELECT week, round(sum(w * log_return) / sum(w), 6) AS basket_return FROM (SELECT rt.week, rt.log_return, 1 + abs(en.s_acctbal) AS w FROM rt JOIN en USING (security_id) WHERE log_return IS NOT NULL) GROUP BY week")
def a09(t: Tables) -> DataFrame:
    e = X.entities(t).select("security_id", (1 + F.abs("s_acctbal")).alias("w"))
    return panel.basket(X.returns(t).join(e, "security_id"), F.col("w")).filter("observed > 0").select("week", r6("basket_return").alias("basket_return"))


@query("a10_weekly_quality", f"WITH {X.RT}, {X.EN} SELECT week, round(sum(CASE WHEN log_return IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) AS weight_fraction, round(avg(CASE WHEN log_return IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS count_fraction FROM (SELECT rt.week, rt.log_return, 1 + abs(en.s_acctbal) AS w FROM rt JOIN en USING (security_id)) GROUP BY week")
def a10(t: Tables) -> DataFrame:
    e = X.entities(t).select("security_id", (1 + F.abs("s_acctbal")).alias("w"))
    seen = F.col("log_return").isNotNull()
    return X.returns(t).join(e, "security_id").groupBy("week").agg(r6(F.sum(F.when(seen, F.col("w")).otherwise(F.lit(0.0))) / F.sum("w")).alias("weight_fraction"), r6(F.avg(seen.cast("double"))).alias("count_fraction"))


@query("a11_column_moments", f"WITH {X.RT} SELECT security_id, round(avg(log_return), 6) AS mean, round(CASE WHEN stddev_samp(log_return) <= 1e-12 THEN 1 ELSE stddev_samp(log_return) END, 6) AS scale, round(var_samp(log_return), 6) AS variance FROM rt GROUP BY 1")
def a11(t: Tables) -> DataFrame:
    sd = F.stddev_samp("log_return")
    return X.returns(t).groupBy("security_id").agg(r6(F.avg("log_return")).alias("mean"), r6(F.when(sd <= 1e-12, F.lit(1.0)).otherwise(sd)).alias("scale"), r6(F.var_samp("log_return")).alias("variance"))


@query("a12_median_min", f"WITH {X.BK} SELECT round(median(observed_fraction), 6) AS median_observed, round(min(observed_fraction), 6) AS least_observed FROM bk")
def a12(t: Tables) -> DataFrame:
    return X.basket(t).agg(r6(F.median("observed_fraction")).alias("median_observed"), r6(F.min("observed_fraction")).alias("least_observed"))


@query("l01_standardized_panel", f"WITH {X.RT}, f AS (SELECT security_id, avg(log_return) AS m, stddev_samp(log_return) AS s, count(log_return) AS n FROM rt WHERE week <= DATE '{TRAIN_END}' GROUP BY 1) SELECT rt.security_id, rt.week, round((rt.log_return - f.m) / CASE WHEN f.s <= 1e-12 THEN 1 ELSE f.s END, 6) AS z FROM rt JOIN f USING (security_id) WHERE f.n >= 2 AND rt.log_return IS NOT NULL")
def l01(t: Tables) -> DataFrame:
    rt = X.returns(t)
    fit = rt.filter(F.col("week") <= F.lit(TRAIN_END).cast("date")).groupBy("security_id").agg(F.avg("log_return").alias("m"), F.stddev_samp("log_return").alias("s"), F.count("log_return").alias("n")).filter("n >= 2")
    return rt.filter("log_return is not null").join(fit, "security_id").select("security_id", "week", r6((F.col("log_return") - F.col("m")) / F.when(F.col("s") <= 1e-12, F.lit(1.0)).otherwise(F.col("s"))).alias("z"))


@query("l12_group_basket", f"WITH {X.RT}, {X.EN} SELECT coalesce(country, sector, 'global') AS grp, week, round(avg(log_return), 6) AS group_return, count(log_return) AS observed FROM rt JOIN en USING (security_id) GROUP BY GROUPING SETS ((week), (week, country), (week, sector))")
def l12(t: Tables) -> DataFrame:
    """Global, country and sector baskets: one pass, each row in its three groups before the partial sums."""
    e = X.entities(t).select("security_id", F.explode(F.array(F.lit("global"), "country", "sector")).alias("grp"))
    return X.returns(t).join(e, "security_id").groupBy("grp", "week").agg(r6(F.avg("log_return")).alias("group_return"), F.count("log_return").alias("observed"))


@query("l12_group_weights", f"WITH {X.EN}, g AS (SELECT security_id, unnest(['global', country, sector]) AS grp FROM en) SELECT security_id, grp, round(1 / CAST(count(*) OVER (PARTITION BY grp) AS DOUBLE), 8) AS weight FROM g")
def l12w(t: Tables) -> DataFrame:
    e = X.entities(t).select("security_id", F.explode(F.array(F.lit("global"), "country", "sector")).alias("grp"))
    sizes = e.groupBy("grp").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(sizes), "grp").select("security_id", "grp", r6(1 / F.col("n"), 8).alias("weight"))


@query("l15_factor_normaliser", f"WITH {X.BK} SELECT round(avg(basket_return), 8) AS mean, round(stddev_samp(basket_return), 8) AS scale, count(basket_return) AS n FROM bk WHERE week <= DATE '{TRAIN_END}'")
def l15(t: Tables) -> DataFrame:
    return X.basket(t).filter(F.col("week") <= F.lit(TRAIN_END).cast("date")).agg(r6(F.avg("basket_return"), 8).alias("mean"), r6(F.stddev_samp("basket_return"), 8).alias("scale"), F.count("basket_return").alias("n"))


@query("a25_cutoff_audit", f"WITH {X.RT}, m AS (SELECT max(week) FILTER (WHERE week <= DATE '{TRAIN_END}') AS a, max(week) FILTER (WHERE week <= DATE '2000-12-29') AS b, min(week) FILTER (WHERE week > DATE '2000-12-29') AS c FROM rt WHERE log_return IS NOT NULL) SELECT 'fit' AS category, 'train_last_week' AS field, a AS value, DATE '{TRAIN_END}' AS allowed_max, a <= DATE '{TRAIN_END}' AS passed FROM m UNION ALL SELECT 'fit', 'validation_last_week', b, DATE '2000-12-29', b <= DATE '2000-12-29' FROM m UNION ALL SELECT 'test', 'test_first_week', c, NULL, c > DATE '2000-12-29' FROM m")
def a25(t: Tables) -> DataFrame:
    d = lambda s: F.lit(s).cast("date")
    w = F.col("week")
    m = X.returns(t).filter("log_return is not null").agg(F.max(F.when(w <= d(TRAIN_END), w)).alias("a"), F.max(F.when(w <= d("2000-12-29"), w)).alias("b"), F.min(F.when(w > d("2000-12-29"), w)).alias("c"))
    row = lambda cat, field, v, most, ok: F.struct(F.lit(cat).alias("category"), F.lit(field).alias("field"), F.col(v).alias("value"), most.alias("allowed_max"), ok.alias("passed"))
    rows = F.array(row("fit", "train_last_week", "a", d(TRAIN_END), F.col("a") <= d(TRAIN_END)), row("fit", "validation_last_week", "b", d("2000-12-29"), F.col("b") <= d("2000-12-29")), row("test", "test_first_week", "c", F.lit(None).cast("date"), F.col("c") > d("2000-12-29")))
    return m.select(F.inline(rows))


@query("a26_weight_report", f"WITH {X.EN} SELECT round(sum(1 / n), 8) AS total, round(min(1 / n), 8) AS least, round(max(1 / n), 8) AS most, round(avg(CASE WHEN s_acctbal < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS negative_fraction, array_to_string(list_sort(list(DISTINCT currency)), ',') AS currencies FROM (SELECT *, CAST(count(*) OVER () AS DOUBLE) AS n FROM en)")
def a26(t: Tables) -> DataFrame:
    n = F.count("*")
    g = X.entities(t).agg(n.alias("n"), F.avg((F.col("s_acctbal") < 0).cast("double")).alias("neg"), F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("currencies"))
    return g.select(r6(F.col("n") * (1 / F.col("n")), 8).alias("total"), r6(1 / F.col("n"), 8).alias("least"), r6(1 / F.col("n"), 8).alias("most"), r6("neg", 8).alias("negative_fraction"), "currencies")


@query("a38_period_timeline", f"WITH {X.WK}, o AS (SELECT max(CAST(o_orderdate AS DATE)) AS o FROM orders) SELECT (SELECT max(week) FROM wk) AS last_week, o AS last_order, greatest((SELECT max(week) FROM wk), o) AS latest FROM o")
def a38(t: Tables) -> DataFrame:
    w = X.weekly(t).agg(F.max("week").alias("last_week"))
    o = t.orders.agg(F.max(F.to_date("o_orderdate")).alias("last_order"))
    return w.crossJoin(o).withColumn("latest", F.greatest("last_week", "last_order"))  # one row by one row


@query("w09_context_windows", f"WITH {X.BK}, c AS (SELECT week, count(basket_return) OVER w AS n, count(*) OVER w AS m, avg(basket_return) OVER w AS a FROM bk WINDOW w AS (ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT week, round(a, 6) AS context_mean FROM c WHERE n = 8 AND m = 8")
def w09(t: Tables) -> DataFrame:
    w = Window.orderBy("week").rowsBetween(-8, -1)  # one row a week
    c = X.basket(t).withColumn("context", F.collect_list("basket_return").over(w)).filter(F.size("context") == 8)
    return c.select("week", r6(F.aggregate("context", F.lit(0.0), lambda a, x: a + x) / 8).alias("context_mean"))


@query("w10_lag_matrix", f"WITH {X.BK} SELECT week, round(l3, 6) AS lag3, round(l2, 6) AS lag2, round(l1, 6) AS lag1, round(basket_return, 6) AS target FROM (SELECT *, lag(basket_return, 1) OVER w AS l1, lag(basket_return, 2) OVER w AS l2, lag(basket_return, 3) OVER w AS l3 FROM bk WINDOW w AS (ORDER BY week)) WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL AND basket_return IS NOT NULL")
def w10(t: Tables) -> DataFrame:
    w = Window.orderBy("week")
    b = X.basket(t).select("week", F.col("basket_return").alias("target"), *(F.lag("basket_return", k).over(w).alias(f"lag{k}") for k in (3, 2, 1)))
    return b.dropna().select("week", *(r6(c).alias(c) for c in ("lag3", "lag2", "lag1", "target")))


@query("w12_observed_prefix", f"WITH {X.RT}, k AS (SELECT security_id, week, log_return, min(CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY week ROWS UNBOUNDED PRECEDING) AS ok FROM rt WHERE week > DATE '{TRAIN_END}') SELECT security_id, count(*) AS weeks, max(week) AS last_week FROM k WHERE ok = 1 GROUP BY 1")
def w12(t: Tables) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    rt = X.returns(t).filter(F.col("week") > F.lit(TRAIN_END).cast("date"))
    return rt.withColumn("ok", F.min(F.col("price").isNotNull().cast("int")).over(w)).filter("ok = 1").groupBy("security_id").agg(F.count("*").alias("weeks"), F.max("week").alias("last_week"))


@query("w14_rebase_to_last", f"WITH {X.BK}, c AS (SELECT week, exp(sum(coalesce(basket_return, 0)) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING)) AS lvl, row_number() OVER (ORDER BY week DESC) AS back FROM bk) SELECT week, round(lvl / (SELECT lvl FROM c WHERE back = 1), 6) AS rebased FROM c WHERE back <= 104")
def w14(t: Tables) -> DataFrame:
    up = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    c = X.basket(t).withColumn("lvl", panel.level(F.coalesce("basket_return", F.lit(0.0)), up)).withColumn("back", F.row_number().over(Window.orderBy(F.desc("week")))).filter("back <= 104")
    last = F.first("lvl").over(Window.orderBy(F.desc("week")))
    return c.select("week", r6(F.col("lvl") / last).alias("rebased"))


@query("w18_prepend_origin", f"WITH {X.UP} SELECT user_id, 0 AS step, 1.0::DOUBLE AS level FROM (SELECT DISTINCT user_id FROM up) UNION ALL SELECT user_id, step, round(level, 6) FROM up")
def w18(t: Tables) -> DataFrame:
    p = X.user_paths(t).select("user_id", F.col("step").cast("long").alias("step"), r6("level").alias("level"))
    return p.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("step"), F.lit(1.0).alias("level")).unionByName(p)


@query("w19_initial_context", f"WITH {X.BK}, k AS (SELECT week, basket_return, row_number() OVER (ORDER BY week DESC) AS back, avg(basket_return) OVER () AS m, stddev_samp(basket_return) OVER () AS s FROM bk WHERE basket_return IS NOT NULL AND week <= DATE '{TRAIN_END}') SELECT week, round((basket_return - m) / s, 6) AS z FROM k WHERE back <= 26")
def w19(t: Tables) -> DataFrame:
    b = X.basket(t).filter(F.col("basket_return").isNotNull() & (F.col("week") <= F.lit(TRAIN_END).cast("date")))
    m = b.agg(F.avg("basket_return").alias("m"), F.stddev_samp("basket_return").alias("s"))
    last = b.orderBy(F.desc("week")).limit(26)
    return last.crossJoin(F.broadcast(m)).select("week", r6((F.col("basket_return") - F.col("m")) / F.col("s")).alias("z"))  # by one row


@query("j10_currency_lookup", f"WITH {X.EN} SELECT security_id, CASE currency WHEN 'GBp' THEN 'GBP' ELSE currency END AS code, CASE currency WHEN 'GBp' THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM en")
def j10(t: Tables) -> DataFrame:
    return X.entities(t).select("security_id", text.currency(F.col("currency")).alias("c")).select("security_id", F.col("c.code").alias("code"), F.col("c.scale").alias("scale"))
