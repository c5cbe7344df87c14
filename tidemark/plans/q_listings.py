"""Queries over names, symbols, listings and their currencies (P-08 to P-11, P-20, F-03, F-06 to F-09, F-21, J-11), of all customers and hosts.

Each customer stands for a holding whose country, symbol, listing and names come from its nation, segment and balance. The twins state the rules anew in SQL; only the constant tables are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import special, text
from tidemark.operators import names
from tidemark.operators import relational as R
from tidemark.plans.registry import Tables, query

#: Countries by nation; one is unknown and one is missing.
LANDS = ["US", "CN", "HK", "SE", "GB", "JP", "TW", "CA", "TH", "DK", "ZA", "IL", "KW", "IN", "BR", "DE", "FR", "KR", "SA", "AU", "EG", "CZ", "ZZ", "", "CH"]
ENDS = ["", "/B", ".A", "*", "/", "B", "/F"]  # of symbols
KINDS = {"AUTOMOBILE": "EQUITY", "BUILDING": "Common Stock", "FURNITURE": "ETF", "HOUSEHOLD": ""}


def holdings(t: Tables) -> DataFrame:
    """(c_custkey, cents, land, source, ticker, kind, name, resolved, method, was) of each customer."""
    c = t.customer.select("c_custkey", F.round(F.abs("c_acctbal") * 100).cast("long").alias("cents"), "c_nationkey", "c_mktsegment", "c_acctbal")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    cents, land = F.col("cents"), pick(LANDS, F.col("c_nationkey"))
    digits = lambda n: (cents % 10**n).cast("string")
    letters = F.concat(F.substring("c_mktsegment", 1, 3).alias("x"), F.when(cents % 3 == 0, "").when(cents % 3 == 1, F.substring("c_mktsegment", 4, 1)).otherwise(F.substring("c_mktsegment", 4, 2)), pick(ENDS, cents % 7))
    source = F.when(cents % 23 == 0, "--").when(land == "CN", F.lpad(digits(6), 6, "0")).when(land.isin("HK", "TW", "JP"), digits(4)).otherwise(letters)
    got = c.withColumn("land", land).withColumn("source", source).withColumn("other", pick(LANDS, (F.col("c_nationkey") + cents % 2) % 25))
    suffix = F.get(F.coalesce(F.try_element_at(text._table(text.COUNTRY_SUFFIXES), F.col("other")), F.array(F.lit(".QQ"))), F.lit(0))
    ticker = F.when(cents % 11 == 0, "").otherwise(F.concat(F.regexp_replace("source", "[*/]", ""), suffix))
    kind = F.try_element_at(text._table(KINDS), F.col("c_mktsegment"))
    name = F.concat(F.col("c_mktsegment"), F.lit(" Company Ltd "), pick(["", "of", "Class A"], cents % 3), F.lit(" "), F.col("land"))
    resolved = F.when(cents % 13 == 0, "").otherwise(F.concat(F.lit("The "), F.substring("c_mktsegment", 1, 6), pick([" group", "", "s & sons"], cents % 3), F.lit(" "), F.col("other")))
    return got.select("c_custkey", "cents", "land", "source", ticker.alias("ticker"), kind.alias("kind"), name.alias("name"), resolved.alias("resolved"), F.when(cents % 5 == 0, "direct_symbol").otherwise("search").alias("method"), (F.col("c_acctbal") > 0).alias("was"))


def _text(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_list(v) if isinstance(v, list) else repr(v) if isinstance(v, float) else _text(v) for v in r) + ")" for r in rows) + ")"


_SFX = f"sf AS (SELECT * FROM {_values(text.COUNTRY_SUFFIXES.items())} v(land, sf))"
HD = (
    f"{_SFX}, c0 AS (SELECT c_custkey, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents, c_nationkey AS nk, c_mktsegment AS seg, c_acctbal, {_list(LANDS)}[c_nationkey + 1] AS land FROM customer),"
    f" c1 AS (SELECT *, CASE WHEN cents % 23 = 0 THEN '--' WHEN land = 'CN' THEN lpad(CAST(cents % 1000000 AS VARCHAR), 6, '0') WHEN land IN ('HK', 'TW', 'JP') THEN CAST(cents % 10000 AS VARCHAR) ELSE substr(seg, 1, 3 + CAST(cents % 3 AS INTEGER)) || {_list(ENDS)}[cents % 7 + 1] END AS source, {_list(LANDS)}[(nk + cents % 2) % 25 + 1] AS other FROM c0),"
    " hd AS (SELECT c_custkey, cents, c1.land, source, CASE WHEN cents % 11 = 0 THEN '' ELSE regexp_replace(source, '[*/]', '', 'g') || coalesce(sf.sf[1], '.QQ') END AS ticker,"
    " CASE seg WHEN 'AUTOMOBILE' THEN 'EQUITY' WHEN 'BUILDING' THEN 'Common Stock' WHEN 'FURNITURE' THEN 'ETF' WHEN 'HOUSEHOLD' THEN '' END AS kind, seg || ' Company Ltd ' || ['', 'of', 'Class A'][cents % 3 + 1] || ' ' || c1.land AS name,"
    " CASE WHEN cents % 13 = 0 THEN '' ELSE 'The ' || substr(seg, 1, 6) || [' group', '', 's & sons'][cents % 3 + 1] || ' ' || other END AS resolved, CASE WHEN cents % 5 = 0 THEN 'direct_symbol' ELSE 'search' END AS method, c_acctbal > 0 AS was"
    " FROM c1 LEFT JOIN sf ON sf.land = c1.other)"
)
_SUFFIX = "CASE WHEN contains({0}, '.') THEN '.' || split_part({0}, '.', -1) ELSE '' END"


def _fits(t: str, land: str, sf: str) -> str:
    return f"({t} <> '' AND left({t}, 1) <> '^' AND NOT contains({t}, '/') AND NOT contains({t}, '*') AND CASE WHEN {sf} IS NULL THEN true WHEN {land} = 'US' THEN NOT contains({t}, '.') ELSE list_contains({sf}, {_SUFFIX.format(t)}) END)"


_BAD = ", ".join(map(_text, text.PLACEHOLDERS))
_ONCE = "list_filter({0}, lambda v, n: list_position({0}, v) = n)"
#: Symbols, their spellings, suffixes and listings.
SY = (
    HD + ", s0 AS (SELECT hd.*, regexp_replace(replace(upper(trim(source)), '*', ''), '\\s+', '', 'g') AS s, sf.sf AS allowed FROM hd LEFT JOIN sf ON sf.land = hd.land),"
    " s1 AS (SELECT *, list_filter([CASE WHEN land = 'HK' AND regexp_full_match(s, '\\d{1,4}') THEN lpad(s, 4, '0') END, CASE WHEN land IN ('US', 'CA') AND contains(s, '/') THEN replace(s, '/', '-') END, s, replace(s, '.', '-'), replace(s, '/', '-'),"
    " CASE WHEN suffix(s, '/') THEN s[:-2] END, CASE WHEN suffix(s, '/F') THEN s[:-3] END, CASE WHEN land IN ('SE', 'DK', 'NO', 'FI') AND regexp_full_match(s, '[A-Z0-9]{4,}[ABC]') THEN s[:-2] || '-' || s[-1] END],"
    f" lambda v: v IS NOT NULL AND v NOT IN ({_BAD})) AS tried, CASE WHEN land = 'CN' AND regexp_full_match(s, '\\d{{6}}') THEN CASE WHEN s[1] IN ('5', '6', '9') THEN ['.SS'] ELSE ['.SZ', '.BJ'] END ELSE coalesce(allowed, []) END AS suffixes FROM s0),"
    f" sy AS (SELECT *, CASE WHEN s IN ({_BAD}) THEN [] ELSE {_ONCE.format('tried')} END AS variants FROM s1)"
)


@query("f03_name_and_ticker", f"WITH {HD}, x AS (SELECT c_custkey, trim(name || ' (' || source || ')') AS x FROM hd), m AS (SELECT c_custkey, x, length(x) - position('(' IN reverse(x)) AS p FROM x), k AS (SELECT c_custkey, x, p, x[p + 2:-2] AS t FROM m) SELECT c_custkey, CASE WHEN ok THEN trim(x[:p]) ELSE x END AS name, CASE WHEN ok THEN t ELSE '' END AS ticker FROM (SELECT *, length(t) BETWEEN 1 AND 25 AND regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9./_-]*') AS ok FROM k)")
def f03(t: Tables) -> DataFrame:
    written = F.concat("name", F.lit(" ("), "source", F.lit(")"))
    return holdings(t).select("c_custkey", text.name_and_ticker(written).alias("s")).select("c_custkey", "s.name", "s.ticker")


@query("f06_symbol_variants", f"WITH {SY} SELECT c_custkey, source, array_to_string(variants, ',') AS variants FROM sy")
def f06(t: Tables) -> DataFrame:
    return holdings(t).select("c_custkey", "source", F.array_join(text.symbol_variants(F.col("source"), F.col("land")), ",").alias("variants"))


@query("f07_china_exchange", f"WITH {SY} SELECT c_custkey, land, array_to_string(suffixes, ',') AS suffixes FROM sy")
def f07(t: Tables) -> DataFrame:
    return holdings(t).select("c_custkey", "land", F.array_join(text.symbol_suffixes(F.col("source"), F.col("land")), ",").alias("suffixes"))


_LISTED = "flatten(list_transform(variants, lambda b: list_transform(suffixes, lambda x: CASE WHEN x = '.HK' AND regexp_full_match(b, '\\d{1,4}') THEN lpad(b, 4, '0') ELSE b END || x)))"


@query("j11_candidate_listings", f"WITH {SY}, l AS (SELECT c_custkey, land, allowed, list_concat({_LISTED}, CASE WHEN land IN ('US', '') THEN variants ELSE [] END) AS l FROM sy) SELECT c_custkey, array_to_string(list_filter({_ONCE.format('l')}, lambda t: land = '' OR {_fits('t', 'land', 'allowed')}), ',') AS listings FROM l")
def j11(t: Tables) -> DataFrame:
    """Each spelling with each suffix, as long as it is compatible with the country; within a row, so the product is no join."""
    return holdings(t).select("c_custkey", F.array_join(text.candidate_symbols(F.lit(""), F.col("source"), F.col("land")), ",").alias("listings"))


_WORDS = ", ".join(map(_text, special.COMMON_WORDS))


def bare_sql(c: str) -> str:
    return f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(trim({c})), '&', 'and'), '[^a-z0-9%]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w NOT IN ({_WORDS})), ' ')"


#: From pairs(a, b): the longest common substring, the first of equal ones, and then the same on both of its sides; 2 x what matches / all characters.
RATIO = """seg AS (SELECT a, b, a AS x, b AS y, 0 AS k FROM pairs
  UNION ALL SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + n)]), unnest([substr(y, 1, j - 1), substr(y, j + n)]), unnest([n, 0]) FROM
  (SELECT a, b, x, y, m.n AS n, -m.i AS i, -m.j AS j FROM (SELECT a, b, x, y, list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(list_filter(range(1, len(y) + 1), lambda j: y[j] = x[i]),
    lambda j: {'n': len(list_filter(range(1, least(len(x) - i, len(y) - j) + 2), lambda n: substr(x, i, n) = substr(y, j, n))), 'i': -i, 'j': -j})))) AS m FROM seg WHERE x <> '' AND y <> '') WHERE m IS NOT NULL)),
ratio AS (SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE 2 * sum(k) / CAST(len(a) + len(b) AS DOUBLE) END AS similarity FROM seg GROUP BY a, b)"""
NM = f"{HD}, nm AS (SELECT *, {bare_sql('name')} AS a, {bare_sql('resolved')} AS b FROM hd), pairs AS (SELECT DISTINCT a, b FROM nm), {RATIO}"


@query("f08_name_similarity", f"WITH RECURSIVE {NM} SELECT c_custkey, name, resolved, round(similarity, 6) AS similarity FROM nm JOIN ratio USING (a, b)")
def f08(t: Tables) -> DataFrame:
    return holdings(t).select("c_custkey", "name", "resolved", F.round(special.name_similarity(F.col("name"), F.col("resolved")), 6).alias("similarity"))


_HOSTS = f"h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages), hb AS (SELECT h, {bare_sql('h')} AS n FROM h), pairs AS (SELECT DISTINCT l.n AS a, r.n AS b FROM hb l, hb r)"


@query("f08_similar_names", f"WITH RECURSIVE {_HOSTS}, {RATIO} SELECT l.h AS left_name, r.h AS right_name, round(similarity, 6) AS similarity FROM hb l, hb r, ratio WHERE l.n = a AND r.n = b AND similarity >= 0.8 AND l.h < r.h")
def f08_join(t: Tables) -> DataFrame:
    """Pairs of hosts with alike names, of all pages: candidates from an inverted index, not from all pairs."""
    hosts = t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"))
    return names.similar_names(hosts, hosts, 0.8).filter("left_name < right_name").withColumn("similarity", F.round("similarity", 6))


@query("f09_candidate_score", f"WITH RECURSIVE {NM}, q AS (SELECT nm.*, similarity, sf.sf AS allowed, upper(trim(ticker)) AS t, upper(coalesce(kind, '')) AS k, regexp_replace(upper(source), '[^A-Z0-9]', '', 'g') AS s, regexp_replace(split_part(upper(ticker), '.', 1), '[^A-Z0-9]', '', 'g') AS base FROM nm JOIN ratio USING (a, b) LEFT JOIN sf ON sf.land = nm.land) SELECT c_custkey, round(CASE WHEN k <> '' AND NOT contains(k, 'EQUITY') AND NOT contains(k, 'STOCK') OR t = '' OR land <> '' AND NOT {_fits('t', 'land', 'allowed')} THEN -100.0::DOUBLE ELSE 8 * similarity + 2 + CASE WHEN s <> '' AND s = base THEN 3 WHEN s <> '' AND contains(base, s) THEN 1 ELSE 0 END END, 6) AS score FROM q")
def f09(t: Tables) -> DataFrame:
    h = holdings(t).withColumn("similarity", special.name_similarity(F.col("name"), F.col("resolved")))
    return h.select("c_custkey", F.round(text.candidate_score(*(F.col(x) for x in ("kind", "ticker", "land", "source", "similarity"))), 6).alias("score"))


@query("p20_mapping_audit", f"WITH RECURSIVE {NM}, r AS (SELECT nm.*, CASE WHEN NOT was THEN NULL WHEN trim(ticker) = '' THEN 'blank' WHEN method = 'direct_symbol' AND nm.land NOT IN ('', 'US') THEN 'bare_symbol' WHEN nm.land <> '' AND NOT {_fits('ticker', 'nm.land', 'sf.sf')} THEN 'suffix_mismatch' WHEN resolved <> '' AND method <> 'direct_symbol' AND similarity < 0.55 THEN 'name_mismatch' END AS reason FROM nm JOIN ratio USING (a, b) LEFT JOIN sf ON sf.land = nm.land) SELECT c_custkey, reason, was AND reason IS NULL AS verified, CASE WHEN reason IS NULL THEN ticker ELSE '' END AS ticker, CASE WHEN reason IS NULL THEN method ELSE '' END AS method FROM r")
def p20(t: Tables) -> DataFrame:
    """Verified mappings are looked at again, and those that don't hold go back to the start; the first reason counts."""
    m = holdings(t).select("c_custkey", "ticker", F.col("land").alias("country"), "method", "name", "resolved", "was")
    return R.audit_mappings(m, special.name_similarity(F.col("name"), F.col("resolved"))).select("c_custkey", "reason", F.col("was").alias("verified"), "ticker", "method")


_CUR = f"sc AS (SELECT * FROM {_values(text.SUFFIX_CURRENCY.items())} v(s, cur)), lc AS (SELECT * FROM {_values(text.COUNTRY_CURRENCY.items())} v(land, cur)), cu AS (SELECT c_custkey, any_value(hd.ticker) AS ticker, any_value(hd.land) AS land, arg_max(sc.cur, len(sc.s)) AS by_suffix, max(len(sc.s)) AS n, any_value(lc.cur) AS by_land FROM hd LEFT JOIN sc ON suffix(upper(hd.ticker), sc.s) LEFT JOIN lc ON lc.land = hd.land GROUP BY 1)"


@query("p08_suffix_currency", f"WITH {HD}, {_CUR} SELECT c_custkey, ticker, coalesce(by_suffix, by_land, '') AS currency, CASE WHEN n > 0 THEN 'yahoo_suffix:' || upper(right(ticker, n)) WHEN by_land IS NOT NULL THEN 'country:' || land ELSE 'missing' END AS source FROM cu")
def p08(t: Tables) -> DataFrame:
    h = holdings(t).withColumn("c", text.listing_currency(F.col("ticker"), F.col("land")))
    return h.select("c_custkey", "ticker", F.col("c.code").alias("currency"), "c.source")


@query("p09_keyword_currency", f"WITH k AS (SELECT *, row_number() OVER () AS n FROM {_values(text.EXCHANGE_CURRENCY)} v(word, cur)), f AS (SELECT doc_id, arg_min(word, n) AS word, arg_min(cur, n) AS cur FROM documents JOIN k ON contains(upper(trim(text)), word) GROUP BY 1) SELECT d.doc_id, coalesce(cur, '') AS currency, coalesce('exchange:' || word, 'missing') AS source FROM documents d LEFT JOIN f USING (doc_id)")
def p09(t: Tables) -> DataFrame:
    """Over whole texts, as they hold many words: the first of the table's words that one contains."""
    return t.documents.withColumn("c", text.exchange_currency(F.col("text"))).select("doc_id", F.col("c.code").alias("currency"), "c.source")


_QUOTED = "CASE cents % 4 WHEN 0 THEN lower({0}) WHEN 1 THEN ' ' || {0} WHEN 2 THEN {0}[1] || ' ' || {0}[2:] ELSE {0} END"


@query("p10_currency_units", f"WITH {HD}, {_CUR}, q AS (SELECT c_custkey, {_QUOTED.format('coalesce(by_suffix, by_land, chr(39) || chr(39))')} AS quoted FROM cu JOIN hd USING (c_custkey)), u AS (SELECT * FROM {_values((k, *v) for k, v in text.MINOR_UNITS.items())} v(k, code, scale)), x AS (SELECT c_custkey, quoted, trim(quoted) AS e, replace(upper(trim(quoted)), ' ', '') AS p FROM q) SELECT c_custkey, quoted, coalesce(a.code, b.code, p) AS code, CAST(coalesce(a.scale, b.scale, 1.0) AS DOUBLE) AS scale FROM x LEFT JOIN u a ON a.k = e LEFT JOIN u b ON b.k = p")
def p10(t: Tables) -> DataFrame:
    h = holdings(t).withColumn("x", F.nullif(text.listing_currency(F.col("ticker"), F.col("land"))["code"], F.lit("")))
    h = h.withColumn("x", F.coalesce("x", F.lit("''")))
    x, cents = F.col("x"), F.col("cents")
    quoted = F.when(cents % 4 == 0, F.lower(x)).when(cents % 4 == 1, F.concat(F.lit(" "), x)).when(cents % 4 == 2, F.concat(F.substring(x, 1, 1), F.lit(" "), F.expr("substring(x, 2)"))).otherwise(x)
    return h.select("c_custkey", quoted.alias("quoted")).withColumn("c", text.currency(F.col("quoted"))).select("c_custkey", "quoted", "c.code", "c.scale")


_CASH = "|".join(text.CASH_WORDS)


@query("p11_cash_rows", f"WITH {HD}, x AS (SELECT c_custkey, CASE WHEN cents % 3 = 0 THEN kind ELSE '' END AS kind, CASE WHEN cents % 4 = 0 THEN land ELSE ' ' END AS land, ' ' || lower(left(source, 3 + CAST(cents % 2 AS INTEGER))) AS ticker, {_list(['dollar balance', 'Yen', 'cashew', 'CURRENCY;', 'bond'])}[cents % 5 + 1] || ' ' || name AS name FROM hd) SELECT c_custkey, coalesce(kind, '') = '' AND trim(land) = '' AND regexp_full_match(upper(trim(ticker)), '[A-Z]{{3}}') AND regexp_matches(name, '(?i)\\b({_CASH})\\b') AS is_cash FROM x")
def p11(t: Tables) -> DataFrame:
    cents = F.col("cents")
    word = F.get(F.array(*map(F.lit, ["dollar balance", "Yen", "cashew", "CURRENCY;", "bond"])), (cents % 5).cast("int"))
    ticker = F.concat(F.lit(" "), F.lower(F.when(cents % 2 == 0, F.substring("source", 1, 3)).otherwise(F.substring("source", 1, 4))))
    h = holdings(t).select("c_custkey", F.when(cents % 3 == 0, F.col("kind")).otherwise("").alias("kind"), F.when(cents % 4 == 0, F.col("land")).otherwise(" ").alias("land"), ticker.alias("ticker"), F.concat(word, F.lit(" "), "name").alias("name"))
    return h.select("c_custkey", text.is_cash(F.col("kind"), F.col("land"), F.col("ticker"), F.col("name")).alias("is_cash"))


_NAMES = list(text.EXCHANGE_MIC)


@query("f21_symbol_primitives", f"WITH {HD}, mc AS (SELECT * FROM {_values(text.EXCHANGE_MIC.items())} v(e, mic)), x AS (SELECT hd.*, sf.sf AS allowed, ' ' || lower(ticker) AS x, CASE cents % 5 WHEN 0 THEN 'x' || left(lower(source), 3) WHEN 1 THEN NULL ELSE '' END AS mic, upper({_list(_NAMES)}[cents % {len(_NAMES)} + 1]) || '!' AS exchange FROM hd LEFT JOIN sf ON sf.land = hd.land), y AS (SELECT *, regexp_replace(replace(upper(trim(x)), '*', ''), '\\s+', '', 'g') AS symbol, upper(trim(x)) AS t, upper(trim(coalesce(mic, ''))) AS m FROM x) SELECT c_custkey, symbol, {_SUFFIX.format('t')} AS suffix, {_fits('t', 'land', 'allowed')} AS fits, CASE WHEN regexp_full_match(m, '[A-Z0-9]{{4}}') THEN m ELSE coalesce(mc.mic, '') END AS market FROM y LEFT JOIN mc ON mc.e = regexp_replace(lower(exchange), '!', '')")
def f21(t: Tables) -> DataFrame:
    cents, x = F.col("cents"), F.concat(F.lit(" "), F.lower("ticker"))
    mic = F.when(cents % 5 == 0, F.concat(F.lit("x"), F.substring(F.lower("source"), 1, 3))).when(cents % 5 == 1, F.lit(None).cast("string")).otherwise("")
    exchange = F.concat(F.upper(F.get(F.array(*map(F.lit, _NAMES)), (cents % len(_NAMES)).cast("int"))), F.lit("!"))
    return holdings(t).select("c_custkey", text.symbol(x).alias("symbol"), text.symbol_suffix(x).alias("suffix"), text.compatible(F.col("land"), x).alias("fits"), text.market_code(mic, exchange).alias("market"))
