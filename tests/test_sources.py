"""Delimited files of unknown make and web pages: worked examples, files of several MB read as a stream, and pages beside each other."""

import codecs
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidemark.sources import delimited, pages, rules

#: Worked by hand: an export as it is sent, its encoding, and its rows of cells as they are after repair.
EXPORTS = [
    ("fund of today\n\nTicker;Holdings;% of fund\nAAA;Alfa;1,5\n\nBBB;Größe;2;more;still\nTicker;Holdings;% of fund\nCCC\n", "utf-16", "AAA|Alfa|1,5/BBB|Größe|2/CCC||"),
    ("Security name,Shares,Weight,Weight\n\"A, B\",1,2,3\n", "utf-8-sig", "A, B|1|2|3"), ("a,b,c\n1,2,3\n", "utf-8", ""), ("Symbol\tName\tMarket value\tWeight\nX\tÉ\t5\t6\n", "cp1252", "X|É|5|6"),
    ("x|y|z\nTicker|Security|Weight|ISIN\nA|B|C|D\n", "utf-8", "A|B|C|D"), ("", "utf-8", ""),
]



_HEAD = "<tr><th>Ticker</th><th>Holdings</th><th>% of fund*</th></tr>"
_ROWS = "<tr><td>AAA</td><td>Alpha <b>Inc</b></td><td>1.5%</td></tr><tr><td>BBB</td><td>Beta</td></tr>"
_JSON = '{"fund": {"items": [{"ticker": "X", "security": "Ex", "weight": 1}, {"ticker": "Y", "weight": null}]}}'
#: Worked by hand: a page, its best table and its best records as lines of cells, and the addresses of files of holdings in it.
PAGES = [
    (f"<table>{_HEAD}{_ROWS}</table>", "AAA|Alpha Inc|1.5%;BBB|Beta|", "", ""), ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "", "", ""),
    (f"<table><tr><th>Name</th><th>Weight</th></tr><tr><td>n</td><td>9</td></tr></table><p><table>{_HEAD}{_ROWS}</table>", "AAA|Alpha Inc|1.5%;BBB|Beta|", "", ""),
    (f"<table>{_ROWS}</table>", "", "", ""), (f"<script type='application/json'>{_JSON}</script>", "", "X|Ex|1;Y||", ""), (f"<script>var d = {_JSON};</script>", "", "", ""),
    ('<a href="/files/holdings.csv">x</a><a href="mailto:holdings.csv">m</a><a href="/other.csv">o</a>', "", "", "https://example.org/files/holdings.csv"),
    ('<div data-export-url="portfolio?export=1"></div><script>["https:\\/\\/cdn.example.org\\/composition.xlsx", "/x"]</script>', "", "", "https://example.org/fund/portfolio?export=1,https://cdn.example.org/composition.xlsx"),
    ('<script>load("/api/holdings/download?id=7"); go("javascript:holdings.zip")</script><a href="#holdings.zip">y</a>', "", "", "https://example.org/api/holdings/download?id=7"), (None, "", "", ""), ("<p>no table", "", "", ""),
]


def grouped(rows, first):
    """Cells to lines of cells, those of a row in the order of their columns."""
    out = {}
    for r in rows:
        out.setdefault(r[:first], {}).setdefault(r[first], []).append(r[first + 2])
    return {k: ["|".join(v[i]) for i in sorted(v)] for k, v in out.items()}


def test_exports(spark, tmp_path):
    for n, (text, encoding, _) in enumerate(EXPORTS):
        (tmp_path / f"{n}.txt").write_bytes(text.encode(encoding))
    got = grouped(map(tuple, delimited.read_delimited(spark, str(tmp_path)).collect()), 1)
    for n, (*_, want) in enumerate(EXPORTS):
        (found,) = [v for k, v in got.items() if k[0].endswith(f"/{n}.txt")] or [[]]
        assert "/".join(found) == want


def test_headers_below_the_score_are_not_taken():
    rows = lambda text: (lambda got: (got[0], list(got[1])))(delimited.best_rows(lambda: iter(text.splitlines())))
    assert rows("a,b,c\n1,2,3\n") == ([], []) and rows("") == ([], [])
    assert rows("x\nTicker|Security|Market value|Weight\nA|B|C|D\n")[1] == [["A", "B", "C", "D"]]
    # Of two headers that look alike the one with more rows below it; what is no header of its own is a row.
    assert rows("Ticker,Weight,Name\nTicker;Name;Weight\na;b;c\n") == (["Ticker", "Weight", "Name"], [["Ticker;Name;Weight", "", ""], ["a;b;c", "", ""]])
    assert rules.unique_headers(["a", "", "a ", "a", "unnamed_2"]) == ["a", "unnamed_2", "a_2", "a_3", "unnamed_2_2"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10_000])
def test_lines_and_encodings_do_not_depend_on_chunks(size):
    text = "a\r\nb\n\n\x0bc\u2028d\rGröße\r\n"
    for encoding in ("utf-8", "utf-16", "cp1252"):
        raw = (text if encoding != "cp1252" else text.replace("\u2028", "")).encode(encoding)
        chunks = lambda raw=raw: (raw[i : i + size] for i in range(0, len(raw), size))
        found = encoding if encoding == "utf-16" and size < 2 else delimited.encoding_of(chunks)
        assert list(delimited.lines_of(delimited._decoded(chunks(), found))) == codecs.decode(raw, encoding).splitlines()


def test_a_large_file_is_a_stream(spark, tmp_path):
    """Some 20 MB, in UTF-16: memory stays at a few chunks, and all rows come."""
    n = 200_000
    with open(tmp_path / "big.txt", "w", encoding="utf-16") as f:
        f.write("report\n\nTicker;Holdings;% of fund\n")
        f.writelines(f"T{i};Name of number {i} größer;{i / 7:.6f}\n" for i in range(n))
    uri = str(tmp_path / "big.txt")
    tracemalloc.start()
    head, rows = delimited.best_rows(lambda: delimited.lines_of(delimited._decoded(delimited._chunks(uri), delimited.encoding_of(lambda: delimited._chunks(uri)))))
    assert next(rows)[0] == "T0" and sum(1 for _ in rows) == n - 1
    assert tracemalloc.get_traced_memory()[1] < 24 << 20 and (tmp_path / "big.txt").stat().st_size > 15 << 20
    tracemalloc.stop()
    got = delimited.read_delimited(spark, uri, least_rows=n).groupBy("name").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()
    assert {(r["name"], r["n"], r["last"]) for r in got} == {(h, n, n - 1) for h in ("Ticker", "Holdings", "% of fund")}
    assert delimited.read_delimited(spark, uri, least_rows=n + 1).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(i, html, "x", 1) for i, (html, *_) in enumerate(PAGES)], "id long, html string, kind string, row int")
    got = grouped(((r["kind"], r["id"], r["row"], r["name"], r["value"]) for r in pages.html_holdings(df, "id", "html", 2).collect()), 2)
    urls = {}
    for r in sorted(map(tuple, pages.html_urls(df, "id", "html", "https://example.org/fund/page").collect())):
        urls.setdefault(r[0], []).append(r[2])
    for i, (_, best, records, files_) in enumerate(PAGES):
        assert ";".join(got.get(("table", i), [])) == best
        assert ";".join(got.get(("json", i), [])) == records
        assert ",".join(urls.get(i, [])) == files_


def test_bases_by_page(spark):
    df = spark.createDataFrame([(1, '<a href="h/holdings.csv">', "https://a.org/x/y"), (2, '<a href="/holdings.csv">', "http://b.org/x"), (3, None, "http://c.org"), (4, '<a href="/holdings.csv">', None)], "id long, html string, base string")
    assert sorted(map(tuple, pages.html_urls(df, "id", "html", F.col("base")).collect())) == [(1, 0, "https://a.org/x/h/holdings.csv"), (2, 0, "http://b.org/holdings.csv")]
    none = df.limit(0)
    assert pages.html_holdings(none, "id", "html").count() == pages.html_urls(none, "id", "html", "http://a.org").count() == 0
