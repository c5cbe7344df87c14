"""Queries over text, JSON, HTML, sequences and bits (F-, S-, A-30, A-31, P-17, P-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sequence as Q
from tidemark.functions import text
from tidemark.plans.registry import Tables, query
from tidemark.session import keep, scratch
from tidemark.sources import files, pages


@query("f01_label_normalise", "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || '&' || p_type || ' – ' || p_name), '&', 'and', 'g'), '[‐-―]', '-', 'g'), '[^a-z0-9%]+', ' ', 'g'), ' +', ' ', 'g')) AS label FROM part")
def f01(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.label(F.concat_ws("", "p_brand", F.lit("&"), "p_type", F.lit(" – "), "p_name")).alias("label"))


@query("f02_clean_text", "SELECT p_partkey, CASE WHEN trim(coalesce(x, '')) IN ('nan', 'None') THEN '' ELSE trim(coalesce(x, '')) END AS cleaned FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN '  ' || p_name || ' ' ELSE p_name END AS x FROM part)")
def f02(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, None).when(k == 1, "nan").when(k == 2, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", text.clean(x).alias("cleaned"))


@query("f04_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower('-' || p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def f04(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(F.concat(F.lit("-"), "p_brand", F.lit(" "), "p_type")).alias("slug"))


@query("f05_stable_id", "WITH s AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 6 = 0 THEN 'ID' || s_suppkey WHEN s_suppkey % 6 = 1 THEN 'CUSIP-C' || s_suppkey WHEN s_suppkey % 6 = 2 THEN 'SEDOL-S' || s_suppkey WHEN s_suppkey % 6 = 3 THEN 'ISIN-I' || (s_suppkey // 12) ELSE 'VT-' || upper(substr(sha1(s_name || '|' || s_nationkey), 1, 18)) END AS id FROM supplier) SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'VT-' || upper(substr(sha1(id || '|' || s_name || '|' || s_nationkey), 1, 18)) ELSE id END AS id FROM s")
def f05(t: Tables) -> DataFrame:
    k, key = F.col("s_suppkey") % 6, F.col("s_suppkey")
    of = lambda n, p, v=key: F.when(k == n, F.concat(F.lit(p), v.cast("string")))
    made = text.stable_id(of(0, "ID"), of(1, "C"), of(2, "S"), of(3, "I", F.floor(key / 12)), F.col("s_name"), F.col("s_nationkey").cast("string"))
    return text.unique_ids(t.supplier.select("s_suppkey", "s_name", "s_nationkey", made.alias("id")), "id", "s_name", "s_nationkey").select("s_suppkey", "id")


@query("f10_json_pick", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f10(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.json_pick(F.lit(None).cast("string"), F.col("props"), "missing", "k").cast("long").alias("k"))


@query("f11_json_compact", "SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}' AS payload FROM supplier")
def f11(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("payload"))


@query("f12_sha256", "SELECT s_suppkey, sha256(s_name) AS digest FROM supplier")
def f12(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.sha2("s_name", 256).alias("digest"))


@query("f13_fill_from_json", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, json_extract_string(props, '$.k')) AS filled FROM events")
def f13(t: Tables) -> DataFrame:
    own = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return t.events.select("event_id", F.coalesce(own, F.get_json_object("props", "$.k")).alias("filled"))


NOTES = "CASE event_id % 3 WHEN 0 THEN '{\"metadata\":{\"longName\":\"' || event_type || '\"},\"quote\":{}}' WHEN 1 THEN '{\"metadata\":{},\"quote\":{\"shortname\":\"' || event_type || '\"}}' ELSE 'broken{' END"


@query("f22_name_from_notes", f"SELECT event_id, CASE WHEN json_valid(n) THEN coalesce(json_extract_string(n, '$.metadata.longName'), json_extract_string(n, '$.quote.shortname')) END AS name FROM (SELECT event_id, {NOTES} AS n FROM events)")
def f22(t: Tables) -> DataFrame:
    n = t.events.select("event_id", F.expr(NOTES).alias("n"))
    return n.select("event_id", F.coalesce(F.get_json_object("n", "$.metadata.longName"), F.get_json_object("n", "$.quote.shortname")).alias("name"))


@query("f23_metric_format", "SELECT event_id, printf('%.2f%%', value / 7) AS percent, printf('%.4f', value / 3) AS decimals FROM events")
def f23(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.format_string("%.2f%%", F.col("value") / 7).alias("percent"), F.format_string("%.4f", F.col("value") / 3).alias("decimals"))


_CELL = "CASE o_orderstatus WHEN 'P' THEN '(' || format('{:,.2f}', o_totalprice) || ')' WHEN 'F' THEN '$ ' || format('{:,.2f}', o_totalprice) ELSE CASE WHEN o_orderpriority LIKE '%LOW' THEN '—' WHEN o_orderpriority LIKE '1%' THEN o_orderpriority ELSE format('{:.2f}', o_totalprice) || '%' END END"


@query("p18_number_cleanup", f"SELECT o_orderkey, CASE WHEN regexp_matches(y, '^\\(.*\\)$') THEN -TRY_CAST(regexp_replace(y, '[()]', '', 'g') AS DOUBLE) ELSE TRY_CAST(y AS DOUBLE) END AS v FROM (SELECT o_orderkey, trim(regexp_replace({_CELL}, '[,$%— ]', '', 'g')) AS y FROM orders)")
def p18(t: Tables) -> DataFrame:
    """Prices as they would be written: with separators, in brackets, with signs of money, dashes and words for none."""
    price, kind = F.format_string("%,.2f", "o_totalprice"), F.col("o_orderpriority")
    open_ = F.when(kind.endswith("LOW"), "—").when(kind.startswith("1"), kind).otherwise(F.format_string("%.2f%%", "o_totalprice"))
    cell = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("("), price, F.lit(")"))).when(F.col("o_orderstatus") == "F", F.concat(F.lit("$ "), price)).otherwise(open_)
    return t.orders.select("o_orderkey", text.number(cell).alias("v"))


_COD = ", ".join(f"('{c}', '{a}')" for c, a in Q.codons())
_RNA = "rn AS (SELECT doc_id, strpos(r, 'AUG') AS pos0, r FROM (SELECT doc_id, translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'T', 'U') AS r FROM documents))"


@query("f14_transcribe", "SELECT doc_id, translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'T', 'U') AS rna FROM documents")
def f14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", Q.to_rna(F.regexp_replace(F.upper("text"), "[^ACGT]+", "")).alias("rna"))


@query("f15_from_start_codon", f"WITH {_RNA} SELECT doc_id, CASE WHEN pos0 > 0 THEN substr(r, pos0) END AS tail FROM rn")
def f15(t: Tables) -> DataFrame:
    return f14(t).select("doc_id", Q.from_start(F.col("rna")).alias("tail"))


@query("f16_translate_protein", f"WITH {_RNA}, cd(codon, letter) AS (VALUES {_COD}), p AS (SELECT doc_id, substr(r, pos0) AS s FROM rn WHERE pos0 > 0), k AS (SELECT doc_id, i, s[3 * i + 1:3 * i + 3] AS codon FROM p, unnest(range(0, CAST(floor(length(s) / 3) AS BIGINT))) u(i)), l AS (SELECT k.doc_id, k.i, cd.letter, min(CASE WHEN cd.letter = 'X' THEN k.i END) OVER (PARTITION BY doc_id) AS stop FROM k JOIN cd USING (codon)) SELECT doc_id, coalesce(string_agg(CASE WHEN stop IS NULL OR i < stop THEN letter END, '' ORDER BY i), '') AS protein FROM l GROUP BY 1")
def f16(t: Tables) -> DataFrame:
    return f15(t).filter("tail is not null").select("doc_id", Q.protein(F.col("tail")).alias("protein"))


_SHORT = ", ".join(f"('{a}', '{b}')" for a, b in Q.SHORT.items())


_LETTERS = f"{_RNA}, cd(codon, letter) AS (VALUES {_COD}), p AS (SELECT doc_id, substr(r, pos0) AS s FROM rn WHERE pos0 > 0), k AS (SELECT doc_id, i, s[3 * i + 1:3 * i + 3] AS codon FROM p, unnest(range(0, CAST(floor(length(s) / 3) AS BIGINT))) u(i)), l AS (SELECT k.doc_id, k.i, cd.letter, min(CASE WHEN cd.letter = 'X' THEN k.i END) OVER (PARTITION BY doc_id) AS stop FROM k JOIN cd USING (codon)), z AS (SELECT doc_id, i, letter FROM l WHERE stop IS NULL OR i < stop), fs AS (SELECT doc_id, letter, min(i) AS i FROM z GROUP BY 1, 2)"


def _tails(t: Tables) -> DataFrame:
    return f15(t).select("doc_id", F.explode(F.array("tail")).alias("tail")).filter("tail is not null")  # a generator's result: the filter doesn't compute it again


@query("f17_short_names", f"WITH {_LETTERS} SELECT doc_id, string_agg(abbr, '-' ORDER BY i) AS names FROM z JOIN (VALUES {_SHORT}) s(letter, abbr) USING (letter) GROUP BY 1")
def f17(t: Tables) -> DataFrame:
    """Of the proteins that all documents spell; those without a letter have no names."""
    return _tails(t).select("doc_id", Q.short_names(F.col("tail")).alias("names")).filter("names <> ''")


@query("f18_first_seen_letters", f"WITH {_LETTERS} SELECT doc_id, string_agg(letter, '' ORDER BY i) AS letters FROM fs GROUP BY 1")
def f18(t: Tables) -> DataFrame:
    """The letters of each document's protein in the order in which they are first seen; stops are no letters."""
    found = F.array_join(F.array_distinct(Q.letters(F.col("tail"))), "")
    return _tails(t).select("doc_id", F.explode(F.array(found)).alias("letters")).filter("letters <> ''")  # a generator's result: the filter doesn't compute it again


@query("a30_codon_multiplicity", f"WITH {_LETTERS} SELECT letter, count(DISTINCT codon) AS spellings, count(*) AS n FROM k JOIN cd USING (codon) GROUP BY 1")
def a30(t: Tables) -> DataFrame:
    """By how many codons each letter is spelled over all documents, stops included, and how often."""
    table = F.create_map(*(F.lit(x) for pair in Q.codons() for x in pair))
    k = _tails(t).select(F.explode(Q.chunks(F.col("tail"), 3)).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))  # 64 at most
    return k.withColumn("letter", F.try_element_at(table, F.col("codon"))).filter("letter is not null").groupBy("letter").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"))


@query("a31_encoding_count", f"WITH {_LETTERS}, m AS (SELECT letter, count(*) AS n FROM cd GROUP BY 1) SELECT doc_id, string_agg(letter, '' ORDER BY i) AS peptide, CAST(round(product(n)) AS BIGINT) AS ways FROM fs JOIN m USING (letter) GROUP BY 1")
def a31(t: Tables) -> DataFrame:
    """In how many ways DNA can spell the peptide of each document's letters, each once, in the order of their first place."""
    return f18(t).select("doc_id", F.col("letters").alias("peptide"), Q.encodings(F.col("letters")).alias("ways"))


@query("f19_bits", "SELECT event_id, v, array_to_string(list_transform(range(6, -1, -1), lambda k: (v >> k) & 1), '') AS bits FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 128 AS v FROM events)")
def f19(t: Tables) -> DataFrame:
    v = t.events.select("event_id", (F.floor("value") % 128).alias("v"))
    return v.withColumn("bits", F.array_join(Q.to_bits(F.col("v"), 7).cast("array<string>"), ""))


@query("f20_packet_decode", "SELECT event_id, user_id % 32 AS id, v <= 100 AND event_id % 5 <> 0 AS valid, v AS v1, (v + 1) % 128 AS v2, 3 AS v3, 100 AS v4 FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 128 AS v FROM events) WHERE (v + 1) % 128 <= 100 OR v > 100")
def f20(t: Tables) -> DataFrame:
    v = t.events.select("event_id", (F.col("user_id") % 32).alias("i"), (F.floor("value") % 128).alias("v"))
    v = v.filter(((F.col("v") + 1) % 128 <= 100) | (F.col("v") > 100))
    fixed = lambda bits: F.array(*map(F.lit, bits))
    head = F.when(F.col("event_id") % 5 == 0, fixed([1, 1, 1, 1, 1])).otherwise(fixed(Q.HEADER))
    bits = F.concat(head, Q.to_bits(F.col("i"), 5), Q.to_bits(F.col("v"), 7), Q.to_bits((F.col("v") + 1) % 128, 7), Q.to_bits(F.lit(3), 7), Q.to_bits(F.lit(100), 7), fixed(Q.TRAILER))
    return v.select("event_id", Q.packet(bits).alias("p")).select("event_id", "p.*")


@query("s01_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def s01(t: Tables) -> DataFrame:
    """Two columns and a filter that reach the scan."""
    return files.read_parquet(t.spark, f"{t.sf_dir}/orders.parquet").filter("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("s02_parquet_round_trip", "SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS INTEGER) AS s_nationkey FROM supplier")
def s02(t: Tables) -> DataFrame:
    with scratch(t.spark) as path:
        files.write_parquet(t.supplier.select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), path, ["s_nationkey"])
        return keep(files.read_parquet(t.spark, path).select("s_suppkey", "s_name", "s_acctbal", F.col("s_nationkey").cast("int").alias("s_nationkey")))


@query("s04_csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ', \"' || c_mktsegment || '\"' END AS note FROM customer")
def s04(t: Tables) -> DataFrame:
    """Written with quotes and commas, and read again as text; what was missing is empty."""
    note = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    with scratch(t.spark) as path:
        files.write_csv(t.customer.select("c_custkey", note.alias("note")), path)
        return keep(files.read_csv_text(t.spark, path, ["c_custkey", "note"]))


@query("s03_text_columns", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def s03(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").cast("string").alias("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")).na.fill("")


@query("s05_json_objects", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def s05(t: Tables) -> DataFrame:
    o = F.from_json("props", "k int")
    return t.events.select("event_id", o["k"].alias("k"), F.to_json(o).alias("again"))


@query("s06_array_bundle", "SELECT user_id, count(*) AS n, round(list_sum(list(value ORDER BY event_id)[1:5]), 6) AS head FROM events GROUP BY 1")
def s06(t: Tables) -> DataFrame:
    b = files.array_bundle(t.events, "user_id", "event_id", "value")
    return b.select("user_id", F.size("values").cast("long").alias("n"), F.round(F.aggregate(F.slice("values", 1, 5), F.lit(0.0), lambda a, x: a + x), 6).alias("head"))


@query("s14_links", "SELECT page_id, len(l) AS n, len(list_distinct(l)) AS distinct_links, len(list_filter(l, lambda x: regexp_matches(x, '^https?://'))) AS absolute FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1) AS l FROM pages)")
def s14(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", pages.links().alias("l"))
    size = lambda c: F.size(c).cast("long")
    return p.select("page_id", size("l").alias("n"), size(F.array_distinct("l")).alias("distinct_links"), size(F.filter("l", lambda x: x.rlike("^https?://"))).alias("absolute"))


_S15 = "CASE o_orderkey % 6 WHEN 0 THEN 'no date' WHEN 1 THEN 'Portfolio composition AS OF: ' || strftime(o_orderdate, '%m/%d/%Y') || ' (unaudited)' WHEN 2 THEN 'holdings as  of ' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' WHEN 3 THEN 'as of - 2001-02-03, as of ' || strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN 'file ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'as of 13/45/2001' END"


@query("s15_snapshot_dates", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2, 3) THEN CAST(o_orderdate AS DATE) END AS snapshot FROM (SELECT o_orderkey, o_orderdate, {_S15} AS x FROM orders)")
def s15(t: Tables) -> DataFrame:
    """The twin knows which texts say a date; Spark has to find it."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    us, iso = F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "yyyy-MM-dd")
    x = (
        F.when(k == 0, "no date").when(k == 1, F.concat(F.lit("Portfolio composition AS OF: "), us, F.lit(" (unaudited)"))).when(k == 2, F.concat(F.lit("holdings as  of "), iso, F.lit(".csv")))
        .when(k == 3, F.concat(F.lit("as of - 2001-02-03, as of "), us)).when(k == 4, F.concat(F.lit("file "), iso)).otherwise("as of 13/45/2001")
    )
    return t.orders.select("o_orderkey", text.snapshot_date(x).alias("snapshot"))


@query("s22_codon_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT doc_id, regexp_extract(trim(line), '^([^ \\t\\f\\r]*)[ \\t\\f\\r]+([^ \\t\\f\\r]+)[ \\t\\f\\r]+([^ \\t\\f\\r]+)[ \\t\\f\\r]+(.*)$', ['codon', 'abbr', 'letter', 'name']) AS f FROM l) SELECT doc_id, f.codon AS codon, f.abbr AS abbr, f.letter AS letter, f.name AS name FROM f WHERE f.letter <> ''")
def s22(t: Tables) -> DataFrame:
    """All lines of all documents with four fields or more, the last field being the rest of the line."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return files.codon_lines(lines, keep=["doc_id"])


@query("s27_file_types", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'csv' WHEN regexp_extract(lower(url), '\\.(csv|xlsx|xls|json|zip|txt|html)\\b', 1) <> '' THEN regexp_extract(lower(url), '\\.(csv|xlsx|xls|json|zip|txt|html)\\b', 1) WHEN page_id % 3 = 1 THEN 'html' ELSE 'bin' END AS type FROM pages")
def s27(t: Tables) -> DataFrame:
    k = F.col("page_id") % 3
    return t.pages.select("page_id", text.file_type(F.when(k == 0, "attachment; filename=x.CSV"), F.col("url"), F.when(k == 1, "text/html").otherwise("application/octet-stream")).alias("type"))
