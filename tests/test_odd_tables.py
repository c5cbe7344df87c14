"""Queries against their SQL over small tables with odd rows."""

import duckdb

from tests.oracle import plain, rows_of_spark
from tidemark.plans import catalog


def both(spark, folder, name, **tables):
    """(the query's rows, its SQL's rows) over tables that are given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in got.fetchall())
    return rows_of_spark(catalog.QUERIES[name](spark, str(folder)))[1], want


def test_milliseconds_are_rounded(spark, tmp_path):
    """Samples less than half a millisecond before an hour, and half a millisecond before 1970, belong to what SQL's epoch_ms says."""
    times = "'2024-01-01 00:59:59.999999'", "'2024-01-01 01:00:00'", "'2024-01-01 00:59:59.999499'", "'1969-12-31 23:59:59.9995'", "'1969-12-31 23:59:59.9996'", "'2024-01-01 02:29:59.9996'"
    events = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP {ts} AS ts, {u}::BIGINT AS user_id, {60.0 - i}::DOUBLE AS value" for u in (1, 2) for i, ts in enumerate(times) if u == 1 or "1969" not in ts)
    for name in ("a32_capture_peak", "x04_fixed_period_samples"):
        got, want = both(spark, tmp_path, name, events=events)
        assert want and got == want


def test_lines_of_one_number_keep_the_order_of_rows(spark, tmp_path):
    """Lines of the same number and part, apart in the table, with falling and rising discounts."""
    lines = "SELECT * FROM (VALUES (1::BIGINT, 7::BIGINT, 2, 0.08::DOUBLE), (2, 7, 1, 0.01), (1, 8, 1, 0.02), (1, 7, 2, 0.04), (2, 7, 1, 0.05), (1, 7, 2, 0.06), (9, 7, 1, 0.03)) v(l_orderkey, l_partkey, l_linenumber, l_discount)"
    tables = {"lineitem": lines, "part": "SELECT * FROM (VALUES (7::BIGINT, 'seven'), (8, 'eight')) v(p_partkey, p_name)", "pages": "SELECT i AS page_id, 'https://a.org/x' AS url, '<article></article>' AS html FROM range(1, 4) t(i)"}
    want = [(1, 0, "8", "2.00%"), (1, 1, "7", "8.00%"), (1, 2, "7", "4.00%"), (1, 3, "7", "6.00%"), (2, 0, "7", "1.00%"), (2, 1, "7", "5.00%")]
    for name in ("s12_html_tables", "s13_json_records"):
        both(spark, tmp_path, name, **tables)  # writes them; SQL leaves the order of such lines open
        got = catalog.QUERIES[name](spark, str(tmp_path)).select("page_id", "row", "ticker", "weight").collect()
        assert sorted(map(tuple, got)) == want


def test_all_addresses_of_a_page(spark, tmp_path):
    """A page whose order has two lines of one part and one of another, and one without an order at a host without a path."""
    lines = "SELECT * FROM (VALUES (1::BIGINT, 7::BIGINT, 1, 0.08::DOUBLE), (1, 8, 2, 0.02), (1, 7, 3, 0.04)) v(l_orderkey, l_partkey, l_linenumber, l_discount)"
    sites = "SELECT * FROM (VALUES (1::BIGINT, 'http://a.org/en/7?x=y', '<article></article>'), (2, 'https://b.org', '<article></article>')) v(page_id, url, html)"
    got, want = both(spark, tmp_path, "s14_file_urls", lineitem=lines, part="SELECT * FROM (VALUES (7::BIGINT, 'seven'), (8, 'eight')) v(p_partkey, p_name)", pages=sites)
    first = ["/files/holdings-1.csv", "/holdings/7.xls", "/holdings/8.xls", "/en/portfolio-1?export=1", "https://cdn.example.org/composition/7.zip", "https://cdn.example.org/composition/8.zip", "/api/holdings/download?id=7", "/api/holdings/download?id=8"]
    hand = [(1, i, u if u.startswith("h") else "http://a.org" + u) for i, u in enumerate(first)] + [(2, 0, "https://b.org/files/holdings-2.csv"), (2, 1, "https://b.org/portfolio-2?export=1")]
    assert got == want
    assert sorted((r["page_id"], r["nth"], r["url"]) for r in catalog.QUERIES["s14_file_urls"](spark, str(tmp_path)).collect()) == hand
