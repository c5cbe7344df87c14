"""Queries over sources of unknown make (S-09, S-10, S-12 to S-14): exports that Spark writes from customers, and the given pages with holdings of orders set into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, query
from tidemark.session import keep, scratch
from tidemark.sources import delimited, pages

#: Delimiters and encodings of the exports.
EXPORTS = [(",", "UTF-8"), (";", "UTF-16LE"), ("\t", "ISO-8859-1"), ("|", "UTF-8")]


@query("s09_delimited_exports", "SELECT c_custkey % 4 AS export, 'C' || c_custkey AS ticker, c_name || ' é' AS holding, printf('%.2f', c_acctbal) AS weight, CASE WHEN c_custkey % 4 = 2 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def s09(t: Tables) -> DataFrame:
    """S-09, S-10: all customers, written by Spark in four encodings with four delimiters; encoding, delimiter and header are found by the reader, a row at a time."""
    c = t.customer.withColumn("export", F.col("c_custkey") % 4)
    cell = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    with scratch(t.spark) as path:
        for n, (delimiter, encoding) in enumerate(EXPORTS):
            rows = c.filter(F.col("export") == n).select(F.concat(F.lit("C"), "c_custkey").alias("Ticker"), F.concat("c_name", F.lit(" é")).alias("Holding"), F.format_string("%.2f", "c_acctbal").alias("Weight"), *([] if n == 2 else [F.col("c_mktsegment").alias("Segment")]))
            rows.write.option("header", True).option("sep", delimiter).option("encoding", encoding).option("emptyValue", "").csv(f"{path}/export={n}")
        cells = delimited.read_delimited(t.spark, f"{path}/*/*.csv")
        got = cells.groupBy("path", "row").agg(*(cell(n).alias(a) for n, a in (("Ticker", "ticker"), ("Holding", "holding"), ("Weight", "weight"), ("Segment", "segment")))).na.fill("", ["segment"])
        return keep(got.select(F.regexp_extract("path", r"export=(\d)", 1).cast("long").alias("export"), "ticker", "holding", "weight", "segment"))


def _held(t: Tables) -> DataFrame:
    """Each page with a table and a script of the lines of the order of its number, and links to files, set before its end. Lines of the same number and part stay in the order of the table's rows."""
    line = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("ticker"), F.regexp_replace("p_name", "e", "&eacute;").alias("marked"), "file", "at", F.col("p_name").alias("security"), F.format_string("%.2f%%", F.col("l_discount") * 100).alias("weight"))
    part = t.part.select("p_partkey", "p_name")
    li = t.lineitem.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).join(t.pages.select(F.col("page_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # an order's
    row = lambda x: F.concat(F.lit("<tr><td>"), x["ticker"], F.lit("</td><td><b>"), x["marked"], F.lit("</b></td><td> "), x["weight"], F.lit(" </td></tr>"))
    table = F.concat(F.lit("<table><tr><th>A</th></tr></table><table><tr><th>Ticker</th><th>Holdings</th><th>% of fund</th></tr>"), F.array_join(F.transform("lines", row), ""), F.lit("</table>"))
    script = F.concat(F.lit('<script type="application/json">{"fund": {"items": '), F.to_json(F.transform("lines", lambda x: F.struct(x["ticker"].alias("ticker"), x["security"].alias("security"), x["weight"].alias("weight")))), F.lit("}}</script>"))
    links = F.concat(F.lit('<a href="/files/holdings-'), F.col("page_id").cast("string"), F.lit('.csv">x</a><a href="/other.csv">y</a>'))
    more = F.concat(F.coalesce(table, F.lit("")), F.coalesce(script, F.lit("")), links)
    return t.pages.join(lines, "page_id", "left").select("page_id", "url", "lines", F.concat(F.regexp_replace("html", "</article>", ""), more, F.lit("</article>")).alias("html"))


LN = "SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR, replace(p_name, 'e', '&eacute;')) - 1 AS BIGINT) AS row, l_partkey::VARCHAR AS ticker, p_name, printf('%.2f%%', l_discount * 100) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT page_id FROM pages)"


def _rows(t: Tables, kind: str, names: tuple[str, str, str]) -> DataFrame:
    got = pages.html_holdings(_held(t), "page_id", "html", 1).filter(F.col("kind") == kind)
    cell = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return got.groupBy(F.col("id").alias("page_id"), "row").agg(*(cell(n).alias(a) for n, a in zip(names, ("ticker", "security", "weight"), strict=True)))


@query("s12_html_tables", f"SELECT page_id, row, ticker, replace(p_name, 'e', 'é') AS security, weight FROM ({LN})")
def s12(t: Tables) -> DataFrame:
    """Of all pages, the best of their tables: a Python table function beside each page."""
    return _rows(t, "table", ("Ticker", "Holdings", "% of fund"))


@query("s13_json_records", f"SELECT page_id, row, ticker, p_name AS security, weight FROM ({LN})")
def s13(t: Tables) -> DataFrame:
    return _rows(t, "json", ("ticker", "security", "weight"))


#: The addresses of a page in the order in which they are found, repeats included: attributes, then strings of JSON scripts, then the text of scripts. A file's name is that of its line's part.
_FOUND = f"""WITH ln AS ({LN}), p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^(https?://[^/?#]+/([^?#]*/)?)', 1) AS folder FROM pages),
u AS (SELECT page_id, 0 AS k, 0 AS row, origin || '/files/holdings-' || page_id || '.csv' AS url FROM p
UNION ALL SELECT page_id, 1, row, origin || '/holdings/' || ticker || '.xls' FROM p JOIN ln USING (page_id)
UNION ALL SELECT page_id, 2, 0, CASE WHEN folder = '' THEN origin || '/' ELSE folder END || 'portfolio-' || page_id || '?export=1' FROM p
UNION ALL SELECT page_id, 3, row, 'https://cdn.example.org/composition/' || ticker || '.zip' FROM p JOIN ln USING (page_id)
UNION ALL SELECT page_id, 4, row, origin || '/api/holdings/download?id=' || ticker FROM p JOIN ln USING (page_id))"""


@query("s14_file_urls", _FOUND + " SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k, row) - 1 AS nth, url FROM (SELECT page_id, url, min((k, row))[1] AS k, min((k, row))[2] AS row FROM u GROUP BY 1, 2)")
def s14b(t: Tables) -> DataFrame:
    """Of all pages, the files of holdings that they name: in attributes, in strings of JSON scripts and in the text of scripts, of the page and of each of its order's lines; whole, by the root and relative; beside addresses of other kinds. Each once."""
    tickers = F.transform("lines", lambda x: x["ticker"])
    each = lambda before, after: F.coalesce(F.array_join(F.transform(tickers, lambda x: F.concat(F.lit(before), x, F.lit(after))), ""), F.lit(""))
    page = F.col("page_id").cast("string")
    attributes = F.concat(each('<a data-download-url="/holdings/', '.xls">x</a>'), F.lit('<div data-export-url="portfolio-'), page, F.lit('?export=1"></div><a href="mailto:holdings.csv">m</a><a href="#holdings.zip">y</a>'))
    cdn = F.concat(F.lit('<script type="application/json">["/x"'), each(r', "https:\/\/cdn.example.org\/composition\/', '.zip"'), F.lit("]</script>"))
    text = F.concat(F.lit("<script>"), each('load("/api/holdings/download?id=', '");'), F.lit('go("javascript:holdings.zip")</script>'))
    held = _held(t).withColumn("html", F.concat(F.regexp_replace("html", "</article>$", ""), attributes, cdn, text, F.lit("</article>")))
    return pages.html_urls(held, "page_id", "html", F.col("url")).withColumnRenamed("id", "page_id")
