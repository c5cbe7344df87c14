"""Queries over rolling evaluation, benchmarks and backtests (R-06, R-07, R-10), of all sectors' returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rng import normal, normal_sql, uniform_sql
from tidemark.operators import evaluate as E
from tidemark.operators import order
from tidemark.operators.stats import LEVELS
from tidemark.plans import fixtures as X
from tidemark.plans.registry import Tables, query

START, ORIGIN = "2000-12-30", "1999-12-31"
SAMPLES, LENGTH, LEAST, RIDGE = 40, 104, 52, 1e-6
NAMES = ["q025", "q10", "q25", "q50", "q75", "q90", "q975"]
r6 = lambda c, n=6: F.round(c, n)


def sectors(t: Tables) -> DataFrame:
    """(sector, week, r): the mean of a sector's observed returns."""
    e = X.entities(t).select("security_id", "sector")
    return X.returns(t).join(e, "security_id").groupBy("sector", "week").agg(F.avg("log_return").alias("r")).filter("r is not null")


SC = f"{X.RT}, {X.EN}, sc AS (SELECT sector, week, avg(log_return) AS r FROM rt JOIN en USING (security_id) GROUP BY 1, 2 HAVING avg(log_return) IS NOT NULL)"
#: Each week's lookback: its values, their moments, and the moments of neighbours for the autoregression.
LB = (
    SC + ", lg AS (SELECT *, lag(r) OVER (PARTITION BY sector ORDER BY week) AS x FROM sc), sm AS (SELECT *, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS o, coalesce(x, 0) AS x0, CASE WHEN x IS NULL THEN 0 ELSE r END AS y0 FROM lg),"
    f" lb AS (SELECT sector, week, r, x, list(r) OVER f AS past, count(*) OVER f AS n, avg(r) OVER f AS mu, stddev_samp(r) OVER f AS sd, sum(o) OVER f AS m, sum(x0) OVER f AS sx, sum(y0) OVER f AS sy, sum(x0 * x0) OVER f AS sxx, sum(x0 * y0) OVER f AS sxy, sum(y0 * y0) OVER f AS syy FROM sm WINDOW f AS (PARTITION BY sector ORDER BY week ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING)),"
    f" ar AS (SELECT *, sxy - sx * sy / m AS cxy, sxx - sx * sx / m AS cxx, syy - sy * sy / m AS cyy FROM lb WHERE n >= {LEAST} AND week >= DATE '{START}'),"
    f" co AS (SELECT *, cxy / (cxx + {RIDGE}) AS b FROM ar), md AS (SELECT *, sy / m - b * sx / m AS a, sqrt(greatest(cyy - 2 * b * cxy + b * b * cxx, 0) / m + 1e-8) AS s FROM co)"
)
_AT = "':' || sector || ':' || strftime(week, '%Y-%m-%d') || ':' || k"
_N = lambda name: normal_sql(f"'52:{name}' || {_AT}")
_CHI = " + ".join(f"pow({_N(f't{i}')}, 2)" for i in range(1, 5))
RM = (
    LB + f", kk AS (SELECT md.*, k FROM md, (SELECT unnest(range(0, {SAMPLES})) AS k)), sa AS ("
    "SELECT sector, week, r, 'zero_return' AS method, 0.0::DOUBLE AS v FROM kk UNION ALL "
    f"SELECT sector, week, r, 'block_bootstrap', past[CAST(floor({uniform_sql(chr(39) + '52:rows' + chr(39) + ' || ' + _AT)} * n) AS BIGINT) + 1] FROM kk UNION ALL "
    f"SELECT sector, week, r, 'gaussian', mu + sd * {_N('gauss')} FROM kk UNION ALL "
    f"SELECT sector, week, r, 'student_t', mu + sd * ({_N('t0')} / sqrt(({_CHI}) / 4) * sqrt(2 / 4.0::DOUBLE)) FROM kk UNION ALL "
    f"SELECT sector, week, r, 'linear', a + b * x + s * {_N('linear')} FROM kk),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY sector, week, method ORDER BY v) AS i FROM sa),"
    f" ev AS (SELECT sector, week, method, any_value(r) AS actual, " + ", ".join(f"quantile_cont(v, {p}) AS {n}" for p, n in zip(LEVELS, NAMES, strict=True)) + f", avg(CASE WHEN v <= r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS percentile, avg(abs(v - r)) - sum((2 * i - {SAMPLES} - 1) * v) / ({SAMPLES} * {SAMPLES}.0::DOUBLE) AS crps FROM rk GROUP BY 1, 2, 3)"
)


def _rolling(t: Tables) -> DataFrame:
    return E.rolling(sectors(t), "sector", "week", "r", START, LENGTH, LEAST, 1, SAMPLES, RIDGE)


@query("r07_rolling_methods", f"WITH {RM} SELECT sector, week, method, round(actual, 6) AS actual, " + ", ".join(f"round({n}, 5) AS {n}" for n in NAMES) + ", round(percentile, 5) AS percentile, round(crps, 5) AS crps, sign(q50) = sign(actual) AS direction_correct FROM ev")
def r07_methods(t: Tables) -> DataFrame:
    """One-step forecasts of five methods for each sector and week, scored. The linear one is an autoregression on normal equations that slide."""
    q = [r6(F.col("q")[i], 5).alias(n) for i, n in enumerate(NAMES)]
    return _rolling(t).select("sector", "week", "method", r6("actual").alias("actual"), *q, r6("percentile", 5).alias("percentile"), r6("crps", 5).alias("crps"), "direction_correct")


@query("r07_method_summary", f"WITH {RM}, su AS (SELECT method, count(*) AS weeks, avg(crps) AS crps, avg(abs(q50 - actual)) AS mae, avg(CASE WHEN sign(q50) = sign(actual) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS direction, " + ", ".join(f"avg(CASE WHEN actual >= {a} AND actual <= {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage_{p}" for a, b, p in (("q25", "q75", 50), ("q10", "q90", 80), ("q025", "q975", 95))) + ", avg(q90 - q10) AS width_80 FROM ev GROUP BY 1) SELECT method, weeks, round(crps, 5) AS crps, round(mae, 5) AS mae, round(direction, 5) AS direction, round(coverage_50, 5) AS coverage_50, round(coverage_80, 5) AS coverage_80, round(coverage_95, 5) AS coverage_95, round(width_80, 5) AS width_80, round((abs(coverage_50 - 0.5::DOUBLE) + abs(coverage_80 - 0.8::DOUBLE) + abs(coverage_95 - 0.95::DOUBLE)) / 3, 5) AS calibration_error FROM su")
def r07_summary(t: Tables) -> DataFrame:
    s = E.summary(_rolling(t))
    return s.select("method", "weeks", *(r6(c, 5).alias(c) for c in ("crps", "mae", "direction", "coverage_50", "coverage_80", "coverage_95", "width_80", "calibration_error")))


PATHS, STEPS = 60, 26
_VAR = (
    f"RECURSIVE {SC}, h AS (SELECT sector, week, r, lag(r) OVER (PARTITION BY sector ORDER BY week) AS x FROM sc WHERE week <= DATE '{ORIGIN}'), c AS (SELECT sector, arg_max(r, week) AS last, count(x) AS m, covar_pop(r, x) AS cxy, var_pop(x) FILTER (x IS NOT NULL) AS cxx, var_pop(r) FILTER (x IS NOT NULL) AS cyy, avg(r) FILTER (x IS NOT NULL) AS my, avg(x) AS mx FROM h GROUP BY 1 HAVING count(x) >= 3),"
    f" b AS (SELECT *, m * cxy / (m * cxx + {RIDGE}) AS b FROM c), v AS (SELECT *, my - b * mx AS a, sqrt(greatest(cyy - 2 * b * cxy + b * b * cxx, 0) + 1e-8) AS s FROM b),"
    f" w AS (SELECT sector, k AS path, CAST(0 AS BIGINT) AS step, last AS r, 0.0::DOUBLE AS total, a, b, s FROM v, (SELECT unnest(range(0, {PATHS})) AS k) UNION ALL SELECT sector, path, step + 1, nr, total + nr, a, b, s FROM (SELECT *, a + b * r + s * {normal_sql(chr(39) + '52:path:' + chr(39) + ' || sector || ' + chr(39) + ':' + chr(39) + ' || path || ' + chr(39) + ':' + chr(39) + ' || (step + 1)')} AS nr FROM w WHERE step < {STEPS}))"
)


@query("r06_var_benchmark", f"WITH {_VAR} SELECT sector, step, round(quantile_cont(exp(total), 0.1), 5) AS q10, round(median(exp(total)), 5) AS q50, round(quantile_cont(exp(total), 0.9), 5) AS q90 FROM w WHERE step > 0 GROUP BY 1, 2")
def r06_var(t: Tables) -> DataFrame:
    """Paths of a stable autoregression of each sector, from a frozen origin: a path is a fold over its own steps, one row of work in the JVM."""
    past = sectors(t).filter(F.col("week") <= F.lit(ORIGIN).cast("date"))
    sums = E.lookbacks(past.unionByName(past.groupBy("sector").agg(F.date_add(F.max("week"), 7).alias("week"), F.lit(0.0).alias("r"))), "sector", "week", "r", 1 << 20, 1)
    last = sums.groupBy("sector").agg(F.max_by(F.struct("sums", "recent"), "week").alias("z")).select("sector", "z.recent", E.autoregression(F.col("z.sums"), 1, RIDGE).alias("m")).filter("m.sd is not null")
    paths = last.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(PATHS - 1))))
    start = F.array(F.struct(F.col("recent")[0].alias("r"), F.lit(0.0).alias("total")))

    def step(so_far, k):
        before = F.element_at(so_far, -1)
        r = F.col("m.intercept") + F.col("m.coefficients")[0] * before["r"] + F.col("m.sd") * normal(52, "path", F.col("sector"), F.col("path"), k)
        return F.concat(so_far, F.array(F.struct(r.alias("r"), (before["total"] + r).alias("total"))))

    walked = paths.select("sector", "path", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)).alias("step", "s")).filter("step > 0")
    levels = walked.select("sector", F.col("step").cast("long").alias("step"), F.exp("s.total").alias("level"))
    q = order.quantiles(levels, ["sector", "step"], "level", (0.1, 0.5, 0.9))
    return q.select("sector", "step", *(r6(F.col("q")[i], 5).alias(n) for i, n in enumerate(("q10", "q50", "q90"))))


HORIZONS = (1, 4, 13)
_OR = f"{SC}, og AS (SELECT DISTINCT date_trunc('quarter', week)::DATE AS origin FROM sc), ft AS (SELECT origin, sector, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd FROM og JOIN sc ON week < origin AND week >= origin - 7 * 260 GROUP BY 1, 2)"


def origins(t: Tables) -> DataFrame:
    """The first day of each quarter in which a sector has a return."""
    return sectors(t).select(F.to_date(F.date_trunc("quarter", "week")).alias("origin")).distinct()


@query("r10_origin_status", f"WITH {_OR} SELECT origin, sector, n, CASE WHEN n >= 104 THEN 'completed' ELSE 'too_little_history' END AS status FROM ft")
def r10_status(t: Tables) -> DataFrame:
    return E.origin_fits(sectors(t), "sector", "week", "r", origins(t), 260, 104).select("origin", "sector", "n", "status")


@query(
    "r10_multi_origin",
    f"WITH {_OR}, hz AS (SELECT unnest({list(HORIZONS)}) AS horizon), ac AS (SELECT origin, sector, horizon, sum(r) AS actual FROM og JOIN sc ON week >= origin AND week < origin + 7 * 13 JOIN hz ON (week - origin) // 7 + 1 <= horizon GROUP BY 1, 2, 3 HAVING count(*) = horizon),"
    f" rw AS (SELECT ac.*, mu, sd, k FROM ac JOIN ft USING (origin, sector), (SELECT unnest(range(0, {SAMPLES})) AS k) WHERE n >= 104), sa AS (SELECT origin, sector, horizon, actual, 'zero_return' AS method, 0.0::DOUBLE AS v FROM rw UNION ALL SELECT origin, sector, horizon, actual, 'gaussian', mu * horizon + sd * sqrt(CAST(horizon AS DOUBLE)) * {normal_sql(chr(39) + '52:origin:' + chr(39) + ' || strftime(origin, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') || ' + chr(39) + ':' + chr(39) + ' || sector || ' + chr(39) + ':' + chr(39) + ' || horizon || ' + chr(39) + ':' + chr(39) + ' || k')} FROM rw),"
    f" rk AS (SELECT *, row_number() OVER (PARTITION BY origin, sector, horizon, method ORDER BY v) AS i FROM sa) SELECT origin, sector, horizon, method, round(any_value(actual), 6) AS actual, round(median(v), 5) AS median_return, round(quantile_cont(v, 0.1), 5) AS q10, round(quantile_cont(v, 0.9), 5) AS q90, round(avg(CASE WHEN v <= actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS percentile, round(avg(abs(v - actual)) - sum((2 * i - {SAMPLES} - 1) * v) / ({SAMPLES} * {SAMPLES}.0::DOUBLE), 5) AS crps FROM rk GROUP BY 1, 2, 3, 4",
)
def r10_origins(t: Tables) -> DataFrame:
    """Each quarter is an origin: forecasts from the five years before it, of each sector over several horizons, against what came."""
    got = E.backtest(sectors(t), "sector", "week", "r", origins(t), HORIZONS, 260, 104, SAMPLES)
    q = lambda p: r6(F.col("q")[LEVELS.index(p)], 5)
    return got.select("origin", "sector", "horizon", "method", r6("actual").alias("actual"), q(0.5).alias("median_return"), q(0.1).alias("q10"), q(0.9).alias("q90"), r6("percentile", 5).alias("percentile"), r6("crps", 5).alias("crps"))
