"""Queries over keyed tables (S-, P-, J-, U-, O-, W-06 to W-08, and plain aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import order
from tidemark.operators import relational as R
from tidemark.plans.registry import Tables, query
from tidemark.session import keep, scratch
from tidemark.sources.stored import Stored


@query("s17_manifest_upsert", "WITH m AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice FROM orders) SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM m) WHERE rn = 1")
def s17(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"))
    old, new = o.filter("o_orderkey % 2 = 1").drop("total"), o.filter("o_orderkey % 2 = 0")
    return R.upsert(old, new, ["o_custkey"], ["day", "o_orderkey"])


@query("s18_pending_set", "WITH last AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS day FROM orders GROUP BY 1), filed AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'), requested AS (SELECT max(CAST(o_orderdate AS DATE)) - 1500 AS day FROM orders) SELECT c_custkey FROM customer, requested r WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.o_custkey = c_custkey AND l.day >= r.day - 10 AND c_custkey IN (SELECT o_custkey FROM filed))")
def s18(t: Tables) -> DataFrame:
    """Done is what is marked so, whose file is there, and whose last date is at most 10 days before the requested end. The rest is pending."""
    day = F.to_date("o_orderdate")
    manifest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", day)).alias("last_date")).withColumn("status", F.when(F.col("last_date").isNotNull(), "ok"))
    files = t.orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    end = t.orders.agg(F.date_sub(F.max(day), 1500).alias("requested_end"))
    return R.pending(t.customer.select("c_custkey"), manifest, files, end, "c_custkey")


@query("s19_unpivot_payload", "SELECT l_suppkey, field, round(sum(v), 2) AS total FROM (SELECT l_suppkey, unnest(['quantity', 'price', 'tax']) AS field, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem) GROUP BY 1, 2")
def s19(t: Tables) -> DataFrame:
    u = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax")).unpivot("l_suppkey", ["quantity", "price", "tax"], "field", "v")
    return u.groupBy("l_suppkey", "field").agg(F.round(F.sum("v"), 2).alias("total"))


@query("s21_batches", "SELECT CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 16) AS BIGINT) AS batch, s_suppkey FROM supplier")
def s21(t: Tables) -> DataFrame:
    return order.places(t.supplier.select("s_suppkey"), "s_suppkey").select(F.floor(F.col("nth") / 16).alias("batch"), "s_suppkey")


@query("s25_valid_symbols", "SELECT l_suppkey AS symbol, count(*) AS fields FROM (SELECT l_suppkey, unnest([CASE WHEN l_discount > 0.05 THEN l_discount END, CASE WHEN l_tax > 0.07 THEN l_tax END]) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1")
def s25(t: Tables) -> DataFrame:
    u = t.lineitem.select(F.col("l_suppkey").alias("symbol"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0.07, F.col("l_tax")).alias("b")).unpivot("symbol", ["a", "b"], "field", "v")
    return u.groupBy("symbol").agg(F.count("v").alias("fields")).filter("fields > 0")


@query("s17_stored_upsert", "SELECT CAST(o_custkey % 8 AS INTEGER) AS part, o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def s17_stored(t: Tables) -> DataFrame:
    """The same on a stored table: each batch of orders rewrites only the parts that it has keys of, and the manifest is switched last."""
    part = (F.col("o_custkey") % 8).cast("int").alias("part")
    o = t.orders.select(part, "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"))
    with scratch(t.spark) as path:
        stored = Stored(t.spark, path, ["part"])
        for n in range(3):
            stored.upsert(o.filter(F.col("o_orderkey") % 3 == n), ["o_custkey"], ["day", "o_orderkey"], run=f"batch{n}")
        return keep(stored.read())


@query("s26_report_upsert", "SELECT o_orderpriority AS name, arg_max(to_json({'orders': n, 'total': total}), batch) AS report FROM (SELECT o_orderpriority, o_orderkey % 3 AS batch, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders WHERE NOT (o_orderkey % 3 = 2 AND o_orderpriority LIKE '%LOW') GROUP BY 1, 2) GROUP BY 1")
def s26(t: Tables) -> DataFrame:
    """A report a priority, keyed, as JSON with keys in order: each batch of orders replaces those that it has."""
    o = t.orders.withColumn("batch", F.col("o_orderkey") % 3).filter(~((F.col("batch") == 2) & F.col("o_orderpriority").endswith("LOW")))
    made = o.groupBy(F.col("o_orderpriority").alias("name"), "batch").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    reports = made.select("name", "batch", F.to_json(F.struct("orders", "total")).alias("report"))
    with scratch(t.spark) as path:
        stored = Stored(t.spark, path, ["name"])
        for n in range(3):
            stored.upsert(reports.filter(F.col("batch") == n), ["name"], ["batch"], run=f"batch{n}")
        return keep(stored.read().select("name", "report"))


@query("p01_reindex_columns", "SELECT s_suppkey AS security_id, s_name AS company_name, CAST(NULL AS VARCHAR) AS isin, CAST(s_acctbal AS DOUBLE) AS market_cap FROM supplier")
def p01(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("company_name"), F.col("s_acctbal").alias("market_cap"))
    return R.align(s, {"security_id": "long", "company_name": "string", "isin": "string", "market_cap": "double"})


ALIASES = {"s_suppkey": "security_id", "s_name": "company_name", "s_acctbal": "market_cap"}


@query("p02_alias_rename", "SELECT s_suppkey AS security_id, s_name AS company_name, s_nationkey, s_acctbal AS market_cap FROM supplier")
def p02(t: Tables) -> DataFrame:
    return t.supplier.withColumnsRenamed(ALIASES)


@query("p03_drop_if_present", "SELECT s_suppkey, s_name FROM supplier")
def p03(t: Tables) -> DataFrame:
    return t.supplier.drop("s_nationkey", "s_acctbal", "no_such_column")


@query("p04_boolean_filter", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW' OR o_custkey % 2 = 0)")
def p04(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000) & ~((F.col("o_orderpriority") == "5-LOW") | (F.col("o_custkey") % 2 == 0))).select("o_orderkey")


@query("p05_membership", "SELECT o_orderstatus IN ('F', 'P') AS listed, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def p05(t: Tables) -> DataFrame:
    return t.orders.filter(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(F.col("o_orderstatus").isin("F", "P").alias("listed")).agg(F.count("*").alias("n"))


@query("p06_multi_branch", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def p06(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 300000, "large").when(p > 100000, "middle").otherwise("small").alias("size"))


@query("p07_first_filled", "WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'USD' ELSE ' ' END AS a, CASE WHEN s_suppkey % 3 = 1 THEN 'EUR' ELSE 'nan' END AS b, CASE WHEN s_suppkey % 9 <> 2 THEN 'JPY' END AS c FROM supplier), n AS (SELECT s_suppkey, nullif(CASE WHEN trim(coalesce(a, '')) IN ('nan', 'None') THEN '' ELSE trim(coalesce(a, '')) END, '') AS a, nullif(CASE WHEN trim(coalesce(b, '')) IN ('nan', 'None') THEN '' ELSE trim(coalesce(b, '')) END, '') AS b, nullif(coalesce(c, ''), '') AS c FROM s) SELECT s_suppkey, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'yahoo' WHEN b IS NOT NULL THEN 'suffix' WHEN c IS NOT NULL THEN 'country' END AS source FROM n")
def p07(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    a, b, c = F.when(k % 3 == 0, "USD").otherwise(" "), F.when(k % 3 == 1, "EUR").otherwise("nan"), F.when(k % 9 != 2, "JPY")
    return t.supplier.select("s_suppkey", text.first_filled(("yahoo", a), ("suffix", b), ("country", c)).alias("f")).select("s_suppkey", F.col("f.value").alias("value"), F.col("f.source").alias("source"))


@query("p13_clip", "SELECT event_id, least(greatest(value, 10.0::DOUBLE), 100.0::DOUBLE) AS clipped FROM events")
def p13(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.least(F.greatest("value", F.lit(10.0)), F.lit(100.0)).alias("clipped"))


@query("p14_sign_hits", "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN sign(value - 50) = sign(user_id - 50) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM events GROUP BY 1")
def p14(t: Tables) -> DataFrame:
    hit = F.signum(F.col("value") - 50) == F.signum((F.col("user_id") - 50).cast("double"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("hits"))


@query("p19_weight_scale", "WITH w AS (SELECT s_suppkey, abs(s_acctbal) AS w FROM supplier), m AS (SELECT max(w) > 1 OR sum(w) > 2 AS percent FROM w) SELECT s_suppkey, round(CASE WHEN percent THEN w / 100 ELSE w END, 6) AS weight FROM w, m")
def p19(t: Tables) -> DataFrame:
    w = t.supplier.select("s_suppkey", F.abs("s_acctbal").alias("w"))
    m = w.agg(((F.max("w") > 1) | (F.sum("w") > 2)).alias("percent"))
    return w.crossJoin(F.broadcast(m)).select("s_suppkey", F.round(F.when(F.col("percent"), F.col("w") / 100).otherwise(F.col("w")), 6).alias("weight"))  # by one row


_P21 = "cd AS (SELECT c_custkey AS key, n AS nth, 'S' || ((c_custkey * 7 + n * n * 13 + c_nationkey) % 400) AS symbol FROM customer, (VALUES (0), (1), (2)) v(n))"


@query("p21_greedy_assignment", f"WITH {_P21}, ok AS (SELECT 'S' || s_suppkey AS symbol FROM supplier), r0 AS (SELECT min(key) AS key, symbol, 0 AS nth FROM cd WHERE nth = 0 AND symbol IN (SELECT symbol FROM ok) GROUP BY symbol HAVING count(*) = 1), r1 AS (SELECT min(key) AS key, symbol, 1 AS nth FROM cd WHERE nth = 1 AND symbol IN (SELECT symbol FROM ok) AND key NOT IN (SELECT key FROM r0) AND symbol NOT IN (SELECT symbol FROM r0) GROUP BY symbol HAVING count(*) = 1), d1 AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1), r2 AS (SELECT min(key) AS key, symbol, 2 AS nth FROM cd WHERE nth = 2 AND symbol IN (SELECT symbol FROM ok) AND key NOT IN (SELECT key FROM d1) AND symbol NOT IN (SELECT symbol FROM d1) GROUP BY symbol HAVING count(*) = 1) SELECT * FROM d1 UNION ALL SELECT * FROM r2")
def p21(t: Tables) -> DataFrame:
    n = F.explode(F.array(*(F.lit(x) for x in range(3)))).alias("nth")
    c = t.customer.select(F.col("c_custkey").alias("key"), "c_nationkey", n)
    c = c.select("key", "nth", F.concat(F.lit("S"), ((F.col("key") * 7 + F.col("nth") * F.col("nth") * 13 + F.col("c_nationkey")) % 400).cast("string")).alias("symbol"))
    return R.greedy_assignment(c, t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")), 3)


@query("p22_conditional_update", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderstatus <> 'F' THEN 'retry_later' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def p22(t: Tables) -> DataFrame:
    keys = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.update_where(o, keys, "o_custkey", {"o_orderstatus": F.lit("retry_later")}, F.col("o_orderstatus") == "F").drop("o_custkey")


@query("p23_work_queue", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 END AS priority FROM orders WHERE o_orderstatus <> 'F' ORDER BY 2, o_totalprice DESC, o_orderkey LIMIT 50")
def p23(t: Tables) -> DataFrame:
    q = t.orders.filter("o_orderstatus <> 'F'").withColumn("priority", F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1))
    return q.orderBy("priority", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "priority")


@query("p24_needs_build", "SELECT count(*) < 5000 OR avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.8 AS rebuild, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM customer")
def p24(t: Tables) -> DataFrame:
    c = F.coalesce(F.avg((F.col("c_acctbal") > 0).cast("double")), F.lit(0.0))
    return t.customer.agg(((F.count("*") < 5000) | (c < 0.8)).alias("rebuild"), F.round(c, 6).alias("coverage"))


@query("j01_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j01(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))  # before the join: fewer rows to move
    return t.customer.select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j02_left_join_two_keys", "WITH s AS (SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2), p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2) SELECT p.l_orderkey, p.l_suppkey, s.total FROM p LEFT JOIN s USING (l_orderkey, l_suppkey)")
def j02(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return t.lineitem.filter("l_linenumber <= 2").select("l_orderkey", "l_suppkey").distinct().join(s, ["l_orderkey", "l_suppkey"], "left")


@query("j03_inner_join_suffixes", "SELECT a.s_suppkey, a.s_acctbal AS s_acctbal_a, b.s_acctbal AS s_acctbal_b FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey + 1")
def j03(t: Tables) -> DataFrame:
    a = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("s_acctbal_a"))
    b = t.supplier.select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.col("s_acctbal").alias("s_acctbal_b"))
    return a.join(b, "s_suppkey")


@query("j04_align_on_date", "WITH a AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS shipped FROM lineitem GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS ordered FROM orders GROUP BY 1) SELECT d, shipped, ordered FROM a LEFT JOIN b USING (d)")
def j04(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("shipped"))
    return a.join(t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("ordered")), "d", "left")


@query("j06_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j06(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("j07_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j07(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("j08_paired_difference", "WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT b.event_type, a.user_id, round(a.v - b.v, 6) AS difference FROM m a JOIN m b USING (user_id) WHERE a.event_type = 'view' AND b.event_type <> 'view'")
def j08(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a = m.filter("event_type = 'view'").select("user_id", F.col("v").alias("base"))
    return m.filter("event_type <> 'view'").join(a, "user_id").select("event_type", "user_id", F.round(F.col("base") - F.col("v"), 6).alias("difference"))


@query("j09_conditional_merge", "WITH c AS (SELECT c_custkey AS k, c_name AS ticker, c_acctbal > 5000 AS verified FROM customer), p AS (SELECT c_custkey AS k, 'OLD' || c_custkey AS ticker, c_acctbal > 8000 OR c_acctbal < 0 AS verified FROM customer WHERE c_custkey % 3 <> 0) SELECT c.k, CASE WHEN p.k IS NOT NULL AND (NOT c.verified OR p.verified) THEN p.ticker ELSE c.ticker END AS ticker, CASE WHEN p.k IS NOT NULL AND (NOT c.verified OR p.verified) THEN p.verified ELSE c.verified END AS verified FROM c LEFT JOIN p USING (k)")
def j09(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("ticker"), (F.col("c_acctbal") > 5000).alias("verified"))
    p = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("OLD"), F.col("c_custkey").cast("string")).alias("ticker"), ((F.col("c_acctbal") > 8000) | (F.col("c_acctbal") < 0)).alias("verified"))
    return R.merge_previous(c.withColumnRenamed("k", "id"), p.withColumnRenamed("k", "id"), "id", ["ticker", "verified"], "verified").withColumnRenamed("id", "k")


@query("j11_candidate_products", "WITH b AS (SELECT s_suppkey, unnest(['A' || s_suppkey, 'A' || (s_suppkey % 10)]) AS base FROM supplier), x AS (SELECT DISTINCT s_suppkey, base || s AS candidate FROM b, (VALUES (''), ('.L'), ('.T')) v(s)) SELECT s_suppkey, candidate FROM x")
def j11(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    bases = F.array_distinct(F.array(F.concat(F.lit("A"), k), F.concat(F.lit("A"), (F.col("s_suppkey") % 10).cast("string"))))
    s = t.supplier.select("s_suppkey", F.explode(bases).alias("base"))
    return s.select("s_suppkey", F.explode(F.array(*(F.concat("base", F.lit(x)) for x in ("", ".L", ".T")))).alias("candidate"))


@query("j12_fold_blocks", "SELECT user_id % 5 AS stock_fold, CAST(floor(event_id / 1000) % 5 AS BIGINT) AS time_fold, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def j12(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 5).alias("stock_fold"), (F.floor(F.col("event_id") / 1000) % 5).alias("time_fold")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("j13_outer_product", "WITH v AS (SELECT l_returnflag AS i, l_linestatus AS j, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2) SELECT a.i AS i, b.i AS k, round(sum(a.x * b.x), 8) AS product FROM v a JOIN v b USING (j) GROUP BY 1, 2")
def j13(t: Tables) -> DataFrame:
    v = t.lineitem.groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.avg("l_discount").alias("x"))
    w = v.select(F.col("i").alias("k"), "j", F.col("x").alias("y"))
    return v.join(w, "j").groupBy("i", "k").agg(F.round(F.sum(F.col("x") * F.col("y")), 8).alias("product"))


@query("w06_last_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def w06(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.last_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("w07_demote_duplicates", "WITH m AS (SELECT c_custkey, c_acctbal > 0 AS verified, 'T' || (c_custkey * 31 % 900) AS ticker FROM customer) SELECT c_custkey, ticker, verified AND (SELECT count(*) FROM m x WHERE x.ticker = m.ticker AND x.verified) <= 1 AS verified FROM m")
def w07(t: Tables) -> DataFrame:
    m = t.customer.select("c_custkey", (F.col("c_acctbal") > 0).alias("verified"), F.concat(F.lit("T"), (F.col("c_custkey") * 31 % 900).cast("string")).alias("ticker"))
    return R.demote_duplicates(m, "ticker", "verified")


@query("w08_rank", "WITH m AS (SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1) SELECT event_type, rank() OVER (ORDER BY mean) AS by_mean, rank() OVER (ORDER BY n DESC) AS by_count FROM m")
def w08(t: Tables) -> DataFrame:
    m = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return m.select("event_type", F.rank().over(Window.orderBy("mean")).cast("long").alias("by_mean"), F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("by_count"))


@query("o01_multi_key_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey DESC, c_custkey) AS place FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey LIMIT 100")
def o01(t: Tables) -> DataFrame:
    top = t.customer.orderBy("c_mktsegment", F.desc("c_nationkey"), "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy("c_mktsegment", F.desc("c_nationkey"), "c_custkey")).cast("long").alias("place"))


@query("o02_sort_descending", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o02(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o03_top_groups", "WITH g AS (SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_suppkey, q FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_suppkey) AS rn FROM g) WHERE rn <= 3")
def o03(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("q"), "l_suppkey")
    return g.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("o04_tail", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 20")
def o04(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("event_id")).limit(20).select("event_id", "value")


@query("o05_limit_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 30")
def o05(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(30).select("o_orderkey")


@query("o06_margin_to_runner_up", "SELECT l_suppkey, l_partkey, round(q - r, 2) AS margin FROM (SELECT *, row_number() OVER w AS rn, lead(q) OVER w AS r FROM (SELECT l_suppkey, l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey)) WHERE rn = 1")
def o06(t: Tables) -> DataFrame:
    q = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return R.ranked_with_margin(q, "l_suppkey", "q", "l_partkey").select("l_suppkey", "l_partkey", F.round("margin", 2).alias("margin"))


@query("u01_union_schemas", "SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier")
def u01(t: Tables) -> DataFrame:
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("u02_ordered_distinct", "SELECT user_id, event_type, first_id FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2)")
def u02(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("u03_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select(F.col("s_nationkey").alias("nation")))


@query("u04_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.select(F.col("o_custkey").alias("id")))


@query("u05_stored_parts", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0")
def u05_stored(t: Tables) -> DataFrame:
    """Parts of a stored table replaced: one by new prices, one by half of its rows; the third is not written again."""
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    with scratch(t.spark) as path:
        stored = Stored(t.spark, path, ["o_orderstatus"])
        stored.replace_parts(o, run="all")
        stored.replace_parts(o.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), run="prices")
        stored.replace_parts(o.filter("o_orderstatus = 'F' and o_orderkey % 2 = 0"), run="half")
        return keep(stored.read())


@query("u05_replace_partition", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, 0.0::DOUBLE FROM orders WHERE o_orderstatus = 'P'")
def u05(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.replace_part(o, o.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), F.col("o_orderstatus") == "P")
