"""Tables, records and file addresses out of web pages, as Python table functions: a page is a row, and what is found in it are rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.rules import TABLE_LEAST, best_table, table_score, unique_headers


def links(html: str = "html"):
    """The targets of href and src attributes, an array."""
    return F.regexp_extract_all(F.col(html), F.lit(r"(?:href|src)=\"([^\"]+)\""), F.lit(1))


class _Page:
    """What is of use in a page: its tables, its scripts, and the attributes that name files."""

    #: The attributes that are looked at.
    ATTRIBUTES = ("href", "src", "data-url", "data-href", "data-download-url", "data-export-url", "download-url")

    def __init__(self, page: str):
        from html.parser import HTMLParser

        self.tables: list[list[list[tuple[str, str]]]] = []  # rows of (tag, text)
        self.scripts: list[str] = []
        self.targets: list[str] = []
        open_: list[int] = []  # tables may stand in tables
        cell: list[tuple[int, str, list[str]]] = []
        outer = self

        class Parser(HTMLParser):
            script = False

            def handle_starttag(self, tag, attrs):
                got = dict(attrs)
                outer.targets.extend(got[a] for a in _Page.ATTRIBUTES if got.get(a))
                if tag == "table":
                    outer.tables.append([])
                    open_.append(len(outer.tables) - 1)
                elif tag == "tr" and open_:
                    outer.tables[open_[-1]].append([])
                elif tag in ("td", "th") and open_ and outer.tables[open_[-1]]:
                    cell.append((open_[-1], tag, []))
                elif tag == "script":
                    self.script = True
                    outer.scripts.append("")

            def handle_endtag(self, tag):
                if tag == "table" and open_:
                    open_.pop()
                elif tag in ("td", "th") and cell:
                    at, kind, parts = cell.pop()
                    outer.tables[at][-1].append((kind, " ".join("".join(parts).split())))
                elif tag == "script":
                    self.script = False

            def handle_data(self, data):
                if self.script:
                    outer.scripts[-1] += data
                elif cell:
                    cell[-1][2].append(data)

        Parser().feed(page or "")

    def frames(self) -> list[tuple[list[str], list[list[str]]]]:
        """(columns, rows) of each table; without a first row of headings the columns have no names."""
        out = []
        for rows in (list(filter(None, t)) for t in self.tables):
            if not rows:
                continue
            width = max(map(len, rows))
            full = [[x for _, x in r] + [""] * (width - len(r)) for r in rows]
            named = all(k == "th" for k, _ in rows[0])
            out.append((unique_headers(full[0]), full[1:]) if named else ([str(i) for i in range(width)], full))
        return out

    def parsed(self) -> Iterable:
        """The scripts that are JSON, whole."""
        for body in self.scripts:
            try:
                yield json.loads(body)
            except ValueError:
                continue

    def records(self, least_rows: int) -> list[tuple[list[str], list[list[str]]]]:
        """(columns, rows) of the lists of objects anywhere in JSON scripts that look like holdings."""
        out = []
        for top in self.parsed():
            for item in parts_of(top):
                if isinstance(item, list) and len(item) >= max(1, least_rows) and all(isinstance(x, dict) for x in item[:20]):
                    columns = list(dict.fromkeys(k for x in item if isinstance(x, dict) for k in x))
                    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
                    if table_score(columns) >= TABLE_LEAST:
                        out.append((columns, [[text(x.get(c)) if isinstance(x, dict) else "" for c in columns] for x in item]))
        return out

    def urls(self, base: str) -> list[str]:
        """The addresses of files of holdings: in attributes, in strings of JSON scripts, and in the text of scripts, each once."""
        import re

        told = [*self.targets, *(x for top in self.parsed() for x in parts_of(top) if isinstance(x, str))]
        for body in self.scripts:
            told += re.findall(r"https?:(?:\\?/){2}[^\"'<>\s]+|/[\w?&=./%+-]+", body, re.A)
        return list(dict.fromkeys(u for x in told if (u := holdings_url(x, base))))


def parts_of(value) -> Iterable:
    """A value of JSON and all that is in it."""
    yield value
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from parts_of(x)


#: Words of addresses that have to do with holdings, and of those that are files.
ABOUT, FILES = ("holding", "portfolio", "composition"), ("export", "download", ".csv", ".xlsx", ".xls", ".zip")


def holdings_url(given: str, base: str) -> str | None:
    """The whole address, if it may be a file of holdings."""
    from urllib.parse import urljoin, urlparse

    x = given.strip().replace("\\/", "/")
    if not x or x.startswith(("javascript:", "mailto:", "#")):
        return None
    try:
        whole = urljoin(base, x)
        scheme = urlparse(whole).scheme
    except ValueError:
        return None
    low = whole.lower()
    return whole if scheme in ("http", "https") and any(w in low for w in ABOUT) and any(w in low for w in FILES) else None


class HoldingsOf:
    """(kind, row, name, value) of a page's best table of holdings, and of the best list of records in its scripts."""

    def eval(self, html: str, least_rows: int) -> Iterator[tuple]:
        page = _Page(html)
        for kind, best in (("table", best_table(page.frames(), least_rows)), ("json", best_table(page.records(least_rows), least_rows))):
            head, body = best or ([], [])
            for i, r in enumerate(body):
                for name, value in zip(head, r, strict=True):
                    yield kind, i, name, value


class FilesOf:
    """(nth, url) of the files of holdings that a page names."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        yield from enumerate(_Page(html).urls(base or ""))


def _beside(df: DataFrame, id_col: str, html_col: str, function: type, returned: str, *more: Column) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *(c.alias(f"more{n}") for n, c in enumerate(more)))
    call = F.udtf(function, returnType=returned)
    found = call(F.col("html").outer(), *(F.col(f"more{n}").outer() for n in range(len(more))))
    return rows.lateralJoin(found).drop("html", *(f"more{n}" for n in range(len(more))))


def html_holdings(df: DataFrame, id_col: str, html_col: str, least_rows: int = 1) -> DataFrame:
    """(id, kind, row, name, value) of each page's best table of holdings and best list of records in its scripts. Pages without any, and null ones, give nothing."""
    return _beside(df, id_col, html_col, HoldingsOf, "kind string, row long, name string, value string", F.lit(least_rows))


def html_urls(df: DataFrame, id_col: str, html_col: str, base: Column | str) -> DataFrame:
    """(id, nth, url) of the files of holdings that each page names; relative addresses are those of ``base``, one for all or a column."""
    return _beside(df, id_col, html_col, FilesOf, "nth long, url string", base if isinstance(base, Column) else F.lit(base))
