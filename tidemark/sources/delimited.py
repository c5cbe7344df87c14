"""Delimited text of unknown make as a Python data source: a file is read as a stream, a row at a time, whatever its size.

Three questions are answered on the way, each by reading no more than is needed: the encoding (the first that takes the whole file), the header (of the first lines, by any delimiter, those that look like one),
and, if several could be it, which of them begins the best table. Rows are then padded or cut to the header's width and handed on as they are parsed; blank rows and repeated headers go.
"""

from __future__ import annotations

import codecs
import csv
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.rules import DELIMITERS, ENCODINGS, HEADER_LEAST, HEADER_LINES, HEADERS, TABLE_LEAST, header_score, label, table_score, unique_headers

CHUNK = 1 << 20
SCHEMA = "path string, row long, name string, value string"
PARTITIONS = 10_000  # at most; more files share them


def opened(uri: str):
    """A stream of bytes, from any store that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return where.open_input_stream(path)


def _decoded(chunks: Iterable[bytes], encoding: str) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(encoding)()
    for chunk in chunks:
        yield decoder.decode(chunk)
    yield decoder.decode(b"", final=True)


def _chunks(uri: str) -> Iterator[bytes]:
    with opened(uri) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def encoding_of(chunks: Callable[[], Iterable[bytes]]) -> str:
    """UTF-16 first if a byte-order mark or NULs near the start tell so; else the first that takes all bytes."""
    start = next(iter(chunks()), b"")
    wide = start[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in start[:4096]
    for name in (*(("utf-16", "utf-16-le", "utf-16-be") if wide else ()), *ENCODINGS):
        try:
            for _ in _decoded(chunks(), name):
                pass
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def lines_of(parts: Iterable[str]) -> Iterator[str]:
    """Lines without their ends; no more than a part and a line are held, as the last line may go on in the next part."""
    rest = ""
    for part in parts:
        *whole, rest = (rest + part).splitlines(keepends=True) or [""]
        yield from (x.splitlines()[0] for x in whole)
    if rest:
        yield rest.splitlines()[0]


def _candidates(lines: Iterable[str]) -> list[tuple[int, str, list[str]]]:
    """(line, delimiter, cells) of what looks like a header, the likeliest first."""
    found = []
    for i, line in zip(range(HEADER_LINES), lines, strict=False):
        for d in DELIMITERS if line.strip() else ():
            cells = next(csv.reader([line], delimiter=d), [])
            if (score := header_score(cells)) >= HEADER_LEAST:
                found.append((-score, i, d, cells))
    return [c[1:] for c in sorted(found, key=lambda x: x[:2])[:HEADERS]]


def _body(lines: Iterator[str], at: int, delimiter: str, cells: list[str]) -> Iterator[list[str]]:
    width, own = len(cells), [label(c) for c in cells]
    for _ in range(at + 1):
        next(lines, None)
    for r in csv.reader(lines, delimiter=delimiter):
        r = [c.strip() for c in r]
        if any(r) and [label(c) for c in r[:width]] != own:
            yield r[:width] + [""] * (width - len(r))


def best_rows(lines: Callable[[], Iterator[str]], least_rows: int = 1) -> tuple[list[str], Iterator[list[str]]]:
    """The header and the rows of the best table: of the highest score by its columns, then with most rows, then the likeliest header; nothing if its score or its rows are too few.

    Only candidates of equal score are read to their ends to count their rows, and rows are not kept.
    """
    by_score: dict[int, list] = {}
    for c in _candidates(lines()):
        by_score.setdefault(table_score(unique_headers(c[2])), []).append(c)
    for score in sorted(by_score, reverse=True):
        counts = [(sum(1 for _ in _body(lines(), *c)), -n) for n, c in enumerate(by_score[score])]
        most, n = max(counts)
        if most:
            if score < TABLE_LEAST or most < least_rows:
                break
            c = by_score[score][-n]
            return unique_headers(c[2]), _body(lines(), *c)
    return [], iter(())


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], least_rows: int):
        self.paths, self.least_rows = paths, least_rows

    def partitions(self) -> list[InputPartition]:
        n = min(len(self.paths), PARTITIONS)
        return [_Files(self.paths[i::n]) for i in range(n)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            encoding = encoding_of(lambda path=path: _chunks(path))
            head, rows = best_rows(lambda path=path, encoding=encoding: lines_of(_decoded(_chunks(path), encoding)), self.least_rows)
            for i, r in enumerate(rows):
                for name, value in zip(head, r, strict=True):
                    yield (path, i, name, value)


class Delimited(DataSource):
    """Option paths: the files, as a JSON array of addresses. Option least_rows: tables with fewer rows are not taken."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_delimited"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("paths", "[]")), int(self.options.get("least_rows", "1")))


def read_delimited(spark: SparkSession, path: str, least_rows: int = 1) -> DataFrame:
    """(path, row, name, value) of the files at a path, a folder or a pattern. Spark lists them, and each is read by one task, a row at a time; files without a table give nothing."""
    spark.dataSource.register(Delimited)
    paths = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names, not contents
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format(Delimited.name()).option("paths", json.dumps(paths)).option("least_rows", str(least_rows)).load()
