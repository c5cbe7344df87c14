"""Queries over simulations (R-, A-29, S-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rng import normal, normal_sql, uniform, uniform_sql
from tidemark.operators import evaluate
from tidemark.operators import simulate as S
from tidemark.operators.stats import LEVELS
from tidemark.plans import fixtures as X
from tidemark.plans.registry import Tables, query

r6 = lambda c, n=6: F.round(c, n)
U = uniform_sql
#: A walk a supplier: its odds, bankroll, box and target come from its balance and nation.
SUP = "sp AS (SELECT s_suppkey AS walk, 0.5::DOUBLE + s_acctbal / 200000 AS p, CAST(8 + s_nationkey % 5 AS BIGINT) AS bank, 4.0::DOUBLE + s_nationkey % 3 AS hw, 3.0::DOUBLE + s_nationkey % 2 AS hh, CAST(s_nationkey % 4 AS DOUBLE) AS aim FROM supplier)"
GRID = SUP + ", g AS (SELECT sp.*, step FROM sp CROSS JOIN (SELECT unnest(range(1, {0} + 1)) AS step))"
FIXED = "g AS (SELECT walk, step FROM (SELECT unnest(range(0, {0})) AS walk) CROSS JOIN (SELECT unnest(range(1, {1} + 1)) AS step))"
W1 = GRID + ", w AS (SELECT walk, step, bank, sum(CASE WHEN " + U("'52:' || walk || ':' || step") + " < p THEN 1 ELSE -1 END) OVER (PARTITION BY walk ORDER BY step ROWS UNBOUNDED PRECEDING) AS x FROM g)"


def suppliers(t: Tables) -> DataFrame:
    n, d = F.col("s_nationkey"), lambda c: c.cast("double")
    return t.supplier.select(F.col("s_suppkey").alias("walk"), (F.lit(0.5) + F.col("s_acctbal") / 200000).alias("p"), (8 + n % 5).cast("long").alias("bank"), d(4 + n % 3).alias("hw"), d(3 + n % 2).alias("hh"), d(n % 4).alias("aim"))


@query("r12_walk_1d", f"WITH {W1.format(100)} SELECT walk, step, CAST(x AS BIGINT) AS x FROM w")
def r12(t: Tables) -> DataFrame:
    return S.walk_1d(t.spark, suppliers(t), 100, p=F.col("p")).select("walk", "step", "x")


ANGLE = f"WITH {GRID.format(100)}, d AS (SELECT walk, step, {U(chr(39) + '52:angle:' + chr(39) + ' || walk || ' + chr(39) + ':' + chr(39) + ' || step')} AS u FROM g), w AS (SELECT walk, step, sum(cos(2 * pi() * u)) OVER o AS x, sum(sin(2 * pi() * u)) OVER o AS y FROM d WINDOW o AS (PARTITION BY walk ORDER BY step ROWS UNBOUNDED PRECEDING))"


@query("r13_walk_angle", ANGLE + " SELECT walk, step, round(x, 6) AS x, round(y, 6) AS y FROM w")
def r13a(t: Tables) -> DataFrame:
    return S.walk_2d(t.spark, suppliers(t), 100, "angle").select("walk", "step", r6("x").alias("x"), r6("y").alias("y"))


def _grid_sql(kind: str, dx: str, dy: str) -> str:
    key = f"'52:{kind}:' || walk || ':' || step"
    return f"WITH {GRID.format(100)}, d AS (SELECT walk, step, {U(key)} AS u FROM g), w AS (SELECT walk, step, sum(CAST({dx} AS DOUBLE)) OVER o AS x, sum(CAST({dy} AS DOUBLE)) OVER o AS y FROM d WINDOW o AS (PARTITION BY walk ORDER BY step ROWS UNBOUNDED PRECEDING))"


G4 = _grid_sql("grid4", "CASE floor(u * 4) WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END", "CASE floor(u * 4) WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END")
G8 = _grid_sql("grid8", "floor(u * 9) % 3 - 1", "floor(floor(u * 9) / 3) - 1")


@query("r13_walk_grid4", G4 + " SELECT walk, step, x, y FROM w")
def r13b(t: Tables) -> DataFrame:
    return S.walk_2d(t.spark, suppliers(t), 100, "grid4").select("walk", "step", "x", "y")


@query("r13_walk_grid8", G8 + " SELECT walk, step, x, y FROM w")
def r13c(t: Tables) -> DataFrame:
    return S.walk_2d(t.spark, suppliers(t), 100, "grid8").select("walk", "step", "x", "y")


_MSD = [k + f", m AS (SELECT '{n}' AS kind, step AS n, avg(x * x + y * y) AS msd, avg(sqrt(x * x + y * y)) AS mad FROM w WHERE step % 20 = 0 GROUP BY 2) SELECT kind, n, round(msd, 6) AS msd, round(mad, 6) AS mad, round(sqrt(n), 6) AS root_n FROM m" for n, k in (("angle", ANGLE), ("grid4", G4), ("grid8", G8))]


@query("a29_displacement", " UNION ALL ".join(f"({s})" for s in _MSD))
def a29(t: Tables) -> DataFrame:
    out = None
    for kind in ("angle", "grid4", "grid8"):
        w = S.walk_2d(t.spark, suppliers(t).select("walk"), 100, kind).filter("step % 20 = 0")
        r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
        m = w.groupBy(F.lit(kind).alias("kind"), F.col("step").alias("n")).agg(r6(F.avg(r2)).alias("msd"), r6(F.avg(F.sqrt(r2))).alias("mad"))
        m = m.withColumn("root_n", r6(F.sqrt(F.col("n").cast("double"))))
        out = m if out is None else out.unionByName(m)
    return out


RUIN = f"WITH {W1.format(400)}, f AS (SELECT walk, min(step) AS steps FROM w WHERE x >= 10 OR x <= -bank GROUP BY 1), e AS (SELECT l.walk AS game, bank, coalesce(f.steps, 400) AS steps, (SELECT x FROM w WHERE w.walk = l.walk AND w.step = coalesce(f.steps, 400)) AS x, f.steps IS NOT NULL AS ended FROM sp l LEFT JOIN f USING (walk)), r AS (SELECT game, steps, CASE WHEN ended THEN x > 0 ELSE bank + x > 10 - x END AS first_won FROM e)"


def _ruin(t: Tables) -> DataFrame:
    return S.ruin(t.spark, suppliers(t), 400, F.col("bank"), 10, F.col("p"))


@query("r11_gamblers_ruin", RUIN + " SELECT game, steps, first_won FROM r")
def r11(t: Tables) -> DataFrame:
    """A game a supplier, whose bankroll and odds are its own."""
    return _ruin(t)


@query("a28_ruin_summary", RUIN + " SELECT round(avg(CASE WHEN first_won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS won, round(avg(steps), 6) AS mean_steps, max(steps) AS most_steps FROM r")
def ruin_summary(t: Tables) -> DataFrame:
    return _ruin(t).agg(r6(F.avg(F.col("first_won").cast("double"))).alias("won"), r6(F.avg("steps")).alias("mean_steps"), F.max("steps").alias("most_steps"))


_DRAWN = f"d AS (SELECT event_id, value, CASE WHEN u < 0.2 THEN 0 WHEN u < 0.5 THEN 1 ELSE 2 END AS k FROM (SELECT event_id, value, {U(chr(39) + '7:' + chr(39) + ' || user_id || ' + chr(39) + ':' + chr(39) + ' || event_id')} AS u FROM events))"


def _drawn(t: Tables) -> DataFrame:
    """Each event's component, by a counter of its user and its own."""
    return t.events.select("event_id", "value", S.categorical([7, F.col("user_id"), F.col("event_id")], [0.2, 0.3, 0.5]).alias("k"))


@query("r01_categorical", f"WITH {_DRAWN} SELECT event_id, k AS drawn FROM d")
def r01(t: Tables) -> DataFrame:
    return _drawn(t).select("event_id", F.col("k").alias("drawn"))


@query("r17_seeded_streams", f"SELECT s AS stream, s_suppkey, round({U('(52 + s) || ' + chr(39) + ':' + chr(39) + ' || s_name')}, 9) AS u FROM (SELECT unnest([0, 20000, 30000, 40000, 60000, 70000]) AS s) CROSS JOIN supplier")
def r17(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", F.explode(F.array(*map(F.lit, (0, 20000, 30000, 40000, 60000, 70000)))).alias("stream"))
    return s.select("stream", "s_suppkey", r6(uniform(F.col("stream") + 52, F.col("s_name")), 9).alias("u"))


@query("r18_selected_parameters", f"WITH {_DRAWN} SELECT event_id, k, round(loc + scale * value, 9) AS drawn FROM d JOIN (VALUES (0, -0.1::DOUBLE, 1.0::DOUBLE), (1, 0.0::DOUBLE, 0.5::DOUBLE), (2, 0.2::DOUBLE, 2.0::DOUBLE)) p(k, loc, scale) USING (k)")
def r18(t: Tables) -> DataFrame:
    """One step of the drawn component, the event's value being the noise; the parameters are a constant array."""
    p = F.get(F.array(*(F.struct(F.lit(loc).alias("loc"), F.lit(scale).alias("scale")) for loc, scale in ((-0.1, 1.0), (0.0, 0.5), (0.2, 2.0)))), F.col("k"))
    return _drawn(t).select("event_id", "k", r6(p["loc"] + p["scale"] * F.col("value"), 9).alias("drawn"))


@query("r16_box_corners", "SELECT i, x0 - w / 2 AS left_c, y0 - h / 2 AS low_c, x0 + w / 2 AS right_c, y0 + h / 2 AS high_c, x0 + w AS right_b, y0 + h AS high_b FROM (SELECT p_partkey AS i, p_retailprice AS x0, CAST(p_size AS DOUBLE) AS y0, CAST(4 + p_size % 3 AS DOUBLE) AS w, CAST(2 + p_size % 2 AS DOUBLE) AS h FROM part)")
def r16(t: Tables) -> DataFrame:
    z = F.col("p_size")
    b = t.part.select(F.col("p_partkey").alias("i"), *(e.cast("double").alias(n) for n, e in (("x0", F.col("p_retailprice")), ("y0", z), ("w", 4 + z % 3), ("h", 2 + z % 2))))
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return b.select("i", (x - w / 2).alias("left_c"), (y - h / 2).alias("low_c"), (x + w / 2).alias("right_c"), (y + h / 2).alias("high_c"), (x + w).alias("right_b"), (y + h).alias("high_b"))


_POS = f"WITH {X.BK}, src AS (SELECT row_number() OVER (ORDER BY week) - 1 AS pos, basket_return AS r FROM bk WHERE basket_return IS NOT NULL), n AS (SELECT count(*) AS n FROM src)"
SB = _POS + f", {FIXED.format(20, 26)}, s AS (SELECT walk, step, CASE WHEN step = 1 OR {U(chr(39) + '52:restart:' + chr(39) + ' || walk || ' + chr(39) + ':' + chr(39) + ' || step')} < 0.125 THEN step END AS fresh, CAST(floor({U(chr(39) + '52:start:' + chr(39) + ' || walk || ' + chr(39) + ':' + chr(39) + ' || step')} * (SELECT n FROM n)) AS BIGINT) AS beg FROM g), b AS (SELECT walk, step, last_value(fresh IGNORE NULLS) OVER o AS bs, last_value(CASE WHEN fresh IS NOT NULL THEN beg END IGNORE NULLS) OVER o AS ba FROM s WINDOW o AS (PARTITION BY walk ORDER BY step ROWS UNBOUNDED PRECEDING)) SELECT walk, step, (ba + step - bs) % (SELECT n FROM n) AS pos, round(r, 8) AS r FROM b JOIN src ON src.pos = (ba + step - bs) % (SELECT n FROM n)"


def _source(t: Tables) -> tuple[DataFrame, int]:
    b = X.basket(t).filter("basket_return is not null")
    src = b.select((F.row_number().over(Window.orderBy("week")) - 1).cast("long").alias("pos"), F.col("basket_return").alias("r"))
    return src, b.count()


@query("r05_stationary_bootstrap", SB)
def r05(t: Tables) -> DataFrame:
    src, n = _source(t)
    return S.stationary_bootstrap(src, t.spark, 20, 26, n, 8.0).withColumn("r", r6("r", 8))


@query("r09_paired_block_interval", _POS + f", r0 AS (SELECT rep, b, CAST(floor({U(chr(39) + '52:' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || b')} * (SELECT n FROM n)) AS BIGINT) AS start FROM (SELECT unnest(range(0, 100)) AS rep) CROSS JOIN (SELECT unnest(range(0, (SELECT CAST(ceil(n / 4.0) AS BIGINT) FROM n))) AS b)), r1 AS (SELECT rep, (start + o) % (SELECT n FROM n) AS pos FROM r0 CROSS JOIN (SELECT unnest(range(0, 4)) AS o) WHERE b * 4 + o < (SELECT n FROM n)), m AS (SELECT rep, avg(r) AS mean FROM r1 JOIN src USING (pos) GROUP BY 1) SELECT round(avg(mean), 8) AS mean_difference, round(quantile_cont(mean, 0.025), 8) AS ci_025, round(quantile_cont(mean, 0.975), 8) AS ci_975 FROM m")
def r09(t: Tables) -> DataFrame:
    src, n = _source(t)
    m = S.paired_block_means(src.withColumnRenamed("r", "d"), t.spark, 100, 4, n)
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return m.agg(F.avg("mean").alias("m"), q.alias("q")).select(r6("m", 8).alias("mean_difference"), r6(F.col("q")[0], 8).alias("ci_025"), r6(F.col("q")[1], 8).alias("ci_975"))


_TURN = "2 * pi() * " + U("'52:{0}:' || walk || ':' || (k + 1)")
_BOX = f"WITH RECURSIVE {SUP}, w AS (SELECT walk, hw, hh, 0 AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, CAST(0 AS BIGINT) AS n FROM sp UNION ALL SELECT walk, hw, hh, k + 1, CASE WHEN ok THEN nx ELSE x END, CASE WHEN ok THEN ny ELSE y END, n + CASE WHEN ok THEN 1 ELSE 0 END FROM (SELECT *, abs(nx) < hw AND abs(ny) < hh AS ok FROM (SELECT *, x + cos({_TURN.format('box')}) AS nx, y + sin({_TURN.format('box')}) AS ny FROM w WHERE k < 200))) SELECT walk, round(x, 6) AS x, round(y, 6) AS y, n AS accepted FROM w WHERE k = 200"


@query("r14_box_walk", _BOX)
def r14(t: Tables) -> DataFrame:
    return S.box_walk(t.spark, suppliers(t), 200, F.col("hw"), F.col("hh")).select("walk", r6("x").alias("x"), r6("y").alias("y"), "accepted")


_TARGET = f"WITH RECURSIVE {SUP}, w AS (SELECT walk, aim, 0 AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, CAST(0 AS BIGINT) AS n, false AS hit FROM sp UNION ALL SELECT walk, aim, k + 1, CASE WHEN mv THEN nx ELSE x END, CASE WHEN mv THEN ny ELSE y END, n + CASE WHEN mv THEN 1 ELSE 0 END, hit OR (mv AND inside) FROM (SELECT *, NOT hit AND (inside OR (abs(nx) <= 10 AND abs(ny) <= 10)) AS mv FROM (SELECT *, nx BETWEEN 3 AND 5 AND ny BETWEEN aim AND aim + 2 AS inside FROM (SELECT *, x + cos({_TURN.format('target')}) AS nx, y + sin({_TURN.format('target')}) AS ny FROM w WHERE k < 400)))) SELECT walk, hit, n AS moves FROM w WHERE k = 400"


@query("r15_target_walk", _TARGET)
def r15(t: Tables) -> DataFrame:
    return S.target_walk(t.spark, suppliers(t), 400, 10.0, (3.0, F.col("aim"), 2.0, 2.0)).select("walk", "hit", "moves")


@query("r06_zero_return", f"WITH {X.BK} SELECT week, row_number() OVER (ORDER BY week) AS step, 0.0::DOUBLE AS weekly_return, 1.0::DOUBLE AS index_value FROM bk WHERE week > DATE '1999-12-31'")
def r06(t: Tables) -> DataFrame:
    """No return in each week after the origin, on the calendar of what is forecast."""
    ahead = X.basket(t).filter(F.col("week") > F.lit("1999-12-31").cast("date")).select("week")
    return ahead.select("week", F.row_number().over(Window.orderBy("week")).cast("long").alias("step"), F.lit(0.0).alias("weekly_return"), F.lit(1.0).alias("index_value"))  # a row a week


_G = f"WITH {X.BK}, m AS (SELECT avg(basket_return) AS mu, stddev_samp(basket_return) AS sd FROM bk), {FIXED.format(100, 26)}, p AS (SELECT walk, step, mu + sd * {normal_sql(chr(39) + '52:gauss:' + chr(39) + ' || walk || ' + chr(39) + ':' + chr(39) + ' || step')} AS r FROM g, m), q AS (SELECT walk, step, exp(least(greatest(sum(r) OVER (PARTITION BY walk ORDER BY step ROWS UNBOUNDED PRECEDING), -80.0::DOUBLE), 80.0::DOUBLE)) AS lvl FROM p)"


def gaussian_paths(t: Tables) -> DataFrame:
    from tidemark.operators import panel

    m = X.basket(t).agg(F.avg("basket_return").alias("mu"), F.stddev_samp("basket_return").alias("sd"))
    g = S.grid(t.spark, 100, 26).crossJoin(F.broadcast(m))  # by one row
    p = g.withColumn("r", F.col("mu") + F.col("sd") * normal(52, "gauss", F.col("walk"), F.col("step")))
    return p.select("walk", "step", "r", panel.level(F.col("r"), Window.partitionBy("walk").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("lvl"))


@query("r06_gaussian_benchmark", _G + " SELECT step, round(quantile_cont(lvl, 0.1), 5) AS q10, round(median(lvl), 5) AS q50, round(quantile_cont(lvl, 0.9), 5) AS q90 FROM q GROUP BY 1")
def r06g(t: Tables) -> DataFrame:
    q = gaussian_paths(t).groupBy("step").agg(F.percentile("lvl", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))  # of as many values as there are paths
    return q.select("step", *(r6(F.col("q")[i], 5).alias(n) for i, n in enumerate(("q10", "q50", "q90"))))


@query("r08_frozen_evaluation", _G + ", a AS (SELECT row_number() OVER (ORDER BY week) AS step, exp(sum(coalesce(basket_return, 0)) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING)) AS actual FROM bk WHERE week > DATE '2000-12-29'), s AS (SELECT q.step, a.actual, q.lvl, row_number() OVER (PARTITION BY q.step ORDER BY lvl) AS i, count(*) OVER (PARTITION BY q.step) AS n FROM q JOIN a USING (step)) SELECT step, round(max(actual), 5) AS actual, round(median(lvl), 5) AS median_index, round(avg(CASE WHEN lvl <= actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS actual_percentile, round(avg(abs(lvl - actual)) - sum((2 * i - n - 1) * lvl) / (max(n) * CAST(max(n) AS DOUBLE)), 5) AS crps FROM s GROUP BY 1")
def r08(t: Tables) -> DataFrame:
    """Paths from a frozen origin against what happened, step by step."""
    w = Window.orderBy("week")
    a = X.basket(t).filter(F.col("week") > F.lit("2000-12-29").cast("date"))
    a = a.select(F.row_number().over(w).cast("long").alias("step"), F.exp(F.sum(F.coalesce("basket_return", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("actual"))
    s = gaussian_paths(t).join(F.broadcast(a), "step")
    each = s.groupBy("step", "actual").agg(F.collect_list("lvl").alias("samples"))  # as many as there are paths
    got = evaluate.scored(each, "samples", "actual")
    return got.select("step", r6("actual", 5).alias("actual"), r6(F.col("q")[LEVELS.index(0.5)], 5).alias("median_index"), r6("percentile", 5).alias("actual_percentile"), r6("crps", 5).alias("crps"))


@query("r07_rolling_one_step", f"WITH {X.BK}, c AS (SELECT week, basket_return AS y, avg(basket_return) OVER w AS mu, stddev_samp(basket_return) OVER w AS sd, count(basket_return) OVER w AS n FROM bk WINDOW w AS (ORDER BY week ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)), s AS (SELECT week, y, mu + sd * {normal_sql(chr(39) + '52:' + chr(39) + ' || strftime(week, ' + chr(39) + '%Y-%m-%d' + chr(39) + ') || ' + chr(39) + ':' + chr(39) + ' || k')} AS x FROM c CROSS JOIN (SELECT unnest(range(0, 50)) AS k) WHERE n >= 26 AND y IS NOT NULL AND week > DATE '2000-12-29') SELECT week, round(median(x), 5) AS median_return, round(avg(CASE WHEN x <= y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS percentile, sign(median(x)) = sign(y) AS direction_correct FROM s GROUP BY week, y")
def r07(t: Tables) -> DataFrame:
    w = Window.orderBy("week").rowsBetween(-52, -1)  # a row a week
    c = X.basket(t).select("week", F.col("basket_return").alias("y"), F.avg("basket_return").over(w).alias("mu"), F.stddev_samp("basket_return").over(w).alias("sd"), F.count("basket_return").over(w).alias("n"))
    c = c.filter((F.col("n") >= 26) & F.col("y").isNotNull() & (F.col("week") > F.lit("2000-12-29").cast("date"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49))))
    s = c.withColumn("x", F.col("mu") + F.col("sd") * normal(52, F.date_format("week", "yyyy-MM-dd"), F.col("k")))
    m = F.median("x")
    return s.groupBy("week", "y").agg(m.alias("m"), F.avg((F.col("x") <= F.col("y")).cast("double")).alias("p")).select("week", r6("m", 5).alias("median_return"), r6("p", 5).alias("percentile"), (F.signum("m") == F.signum("y")).alias("direction_correct"))


@query("r10_multi_seed", "WITH " + ", ".join(f"w{s} AS (SELECT {s} AS seed, avg(CAST(x AS DOUBLE) * x) AS msd FROM (SELECT walk, sum(CASE WHEN " + U(f"'{s}:' || walk || ':' || step") + f" < 0.5 THEN 1 ELSE -1 END) AS x FROM (SELECT unnest(range(0, 50)) AS walk) CROSS JOIN (SELECT unnest(range(1, 51)) AS step) GROUP BY 1))" for s in (1, 2, 3)) + " SELECT round(avg(msd), 6) AS mean, round(stddev_samp(msd), 6) AS deviation, count(*) AS seeds FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)")
def r10(t: Tables) -> DataFrame:
    seeds = S.grid(t.spark, 50, 50).withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    d = seeds.groupBy("seed", "walk").agg(F.sum(F.when(uniform(F.col("seed"), F.col("walk"), F.col("step")) < 0.5, 1).otherwise(-1)).alias("x"))
    m = d.groupBy("seed").agg(F.avg(F.col("x").cast("double") * F.col("x")).alias("msd"))
    return m.agg(r6(F.avg("msd")).alias("mean"), r6(F.stddev_samp("msd")).alias("deviation"), F.count("*").alias("seeds"))


_S20 = f"{X.BK}, f AS (SELECT week, k, {normal_sql(chr(39) + '52:f:' + chr(39) + ' || week || ' + chr(39) + ':' + chr(39) + ' || k')} AS f FROM bk CROSS JOIN (SELECT unnest(range(0, 3)) AS k)), l AS (SELECT s_suppkey, k, {normal_sql(chr(39) + '52:l:' + chr(39) + ' || s_name || ' + chr(39) + ':' + chr(39) + ' || k')} AS l FROM supplier CROSS JOIN (SELECT unnest(range(0, 3)) AS k)), m AS (SELECT s_suppkey, week, sum(f * l) AS common FROM f JOIN l USING (k) GROUP BY 1, 2)"


@query("s20_synthetic_panel", f"WITH {_S20} SELECT s_suppkey, week, CASE WHEN {U(chr(39) + '52:miss:' + chr(39) + ' || s_name || ' + chr(39) + ':' + chr(39) + ' || week')} >= 0.015 THEN round(0.01 * common + 0.02 * {normal_sql(chr(39) + '52:e:' + chr(39) + ' || s_name || ' + chr(39) + ':' + chr(39) + ' || week')}, 6) END AS log_return FROM m JOIN supplier USING (s_suppkey)")
def s20(t: Tables) -> DataFrame:
    """Factors x loadings and noise, 1.5 % missing, of each supplier in each week of the calendar: each cell from its own counters, factors and loadings made once each."""
    of = lambda name, key: F.array(*(normal(52, name, key, k) for k in range(3)))
    weeks = X.basket(t).select("week", of("f", F.col("week")).alias("f"))  # a row a week
    cells = S.spread(t.supplier, "s_suppkey").select("s_suppkey", "s_name", of("l", F.col("s_name")).alias("l")).crossJoin(F.broadcast(weeks))
    common = sum((F.col("f")[k] * F.col("l")[k] for k in (1, 2)), F.col("f")[0] * F.col("l")[0])
    seen = uniform(52, "miss", F.col("s_name"), F.col("week")) >= 0.015
    return cells.select("s_suppkey", "week", F.when(seen, r6(0.01 * common + 0.02 * normal(52, "e", F.col("s_name"), F.col("week")))).alias("log_return"))
