"""Substring dedup by prefix-free parsing, in bytes.

A rolling hash over the last ``TRIGGER`` bytes ends a phrase where it hits a residue. Where phrases end depends on these bytes alone, so equal passages are parsed alike, whatever stands
around them. The corpus order of suffixes is needed only down to ``window`` bytes: which positions agree so far. It comes from two sides, as in prefix-free parsing: what
stands before the first phrase end in a window (a suffix of a phrase, from the dictionary), and what stands after it (the parse from there on).

1. Neighbouring windows that have the same first phrase end, about as far away, make a unit. All of them hold the unit's core, the bytes around this phrase end. A unit is named by its core and by all bytes that its windows cover;
   the named units are the dictionary, and each text is a sequence of them. Windows without a phrase end in reach are units by themselves.
2. Units whose core occurs once in the corpus go. Where a unit as a whole occurs twice, all its windows are repeated, and none is looked at by itself.
3. Only where units share a core and differ outside of it, which happens at the edges of repeats, windows are told apart: a window is a suffix of the unit's left side, the core and a prefix of its right side, and windows that agree in all of these form
   an interval of the corpus order of that depth. Each different unit takes part once, however often it occurs.
4. Bytes that a repeated window covers are removed.

Repeats are found between all texts and within them. Copies of whole texts are told by their digest: all their windows repeat. Units and windows are told by two 64-bit hashes, the core's and their own.

Defined results: a null text is an empty one; a text shorter than a window loses nothing; what is kept are bytes and may start or end within a character; equal rows count as different places; a null id is an id like any
other; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Table, cut, release, small_batches
from tidemark.llm.recompression import _byte_table, _likely, _mix, _Ranges

WINDOW = 400
TRIGGER = 16  # bytes that decide whether a phrase ends behind them
PHRASE = 56  # the mean length of a phrase
_PIECE = 1 << 20  # bytes that are parsed together; longer texts go in pieces that overlap by a window
_U = np.uint64
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def levels(window: int) -> list[tuple[int, int]]:
    """How far a unit's first phrase end is behind the starts of its windows: a range for each level."""
    step, reach = max(window * 4 // 25, 4), window * 7 // 8
    edges = [TRIGGER, TRIGGER + step, TRIGGER + 2 * step, TRIGGER + 4 * step]
    edges = [e for e in edges if e < reach] + [reach + 1]
    return list(zip(edges[:-1], [e - 1 for e in edges[1:]], strict=True))


class Units:
    """The units of some pieces of text that lie one after the other: the first and last start of their windows, core, name."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, window: int):
        n, self.window = len(raw), window
        end = np.append(start[1:], n)
        x = _byte_table()[raw]
        one, self.two = _Ranges(x, _BASE), _Ranges(x, _BASE2)
        hit = _mix((one.sums[TRIGGER:] - one.sums[: n + 1 - TRIGGER]) * one.down[: n + 1 - TRIGGER]) % _U(PHRASE) == 0 if n >= TRIGGER else np.zeros(0, bool)
        b = np.flatnonzero(hit) + TRIGGER  # phrases end before these
        ranges = levels(window)
        reach = ranges[-1][1]
        piece = np.searchsorted(start, b - TRIGGER, side="right") - 1
        last = np.append(-window, b[:-1]) if len(b) else b
        lo = np.maximum(np.maximum(last - TRIGGER + 1, b - reach), start[piece])
        hi = np.minimum(b - TRIGGER, end[piece] - window)
        parts = []
        for k, (near, far) in enumerate(ranges):
            first, final = np.maximum(lo, b - far), np.minimum(hi, b - near)
            ok = first <= final
            first, final, at = first[ok], final[ok], b[ok]
            core = _mix(one.of(at - near, at + window - far) + _U(k + 1))
            name = _mix(self.two.of(first, final + window) ^ _mix(((at - first) * (1 << 20) + (at - final)).astype(np.uint64)))
            parts.append((first, final, core, name))
        # Windows without a phrase end in reach.
        some = np.zeros(n + 1, np.int32)
        holds = end - start >= window
        np.add.at(some, start[holds], 1)
        np.add.at(some, end[holds] - window + 1, -1)
        ok = lo <= hi
        np.add.at(some, lo[ok], -1)
        np.add.at(some, hi[ok] + 1, 1)
        bare = np.flatnonzero(np.cumsum(some[:n]) > 0)
        parts.append((bare, bare, _mix(one.of(bare, bare + window)), _mix(self.two.of(bare, bare + window) + _U(1))))
        self.first, self.final, self.core, self.name = (np.concatenate(p) for p in zip(*parts, strict=True))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window of these units: the unit, where it starts, and its hash."""
        count = self.final[which] - self.first[which] + 1
        unit = np.repeat(which, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[unit]
        return unit, at, _mix(self.two.of(at, at + self.window) + _U(2))


def _bytes(col: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in col]


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: (bytes, where each piece begins in them, its text, where it begins in its text). Each window is in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def packed():
        begin = np.cumsum([0, *(len(p) for *_, p in held)])[:-1]
        return np.frombuffer(b"".join(p for *_, p in held), np.uint8), begin, np.array([d for d, *_ in held]), np.array([o for _, o, _ in held])

    for d, text in enumerate(texts):
        for o in range(0, max(len(text) - window + 1, 0), _PIECE):
            piece = text[o : o + _PIECE + window - 1]
            if held and size + len(piece) > _PIECE:
                yield packed()
                held, size = [], 0
            held.append((d, o, piece))
            size += len(piece)
    if held:
        yield packed()


def _file(window: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # a text is filed once in a task: its copies are told by their digest
        for pdf in batches:
            pdf = pdf[[not (k in seen or seen.add(k)) for k in pdf["d1"].tolist()]]
            d1 = pdf["d1"].to_numpy()
            for raw, begin, doc, _ in _pieces(_bytes(pdf["t"]), window):
                units = Units(raw, begin, window)
                of = d1[doc[np.searchsorted(begin, units.first, side="right") - 1]]
                order = np.lexsort((units.name, units.core, of))
                of, core, name = of[order], units.core[order], units.name[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (core[1:] != core[:-1]) | (name[1:] != name[:-1])
                at = np.flatnonzero(new)
                yield pd.DataFrame({"d1": of[at], "core": core[at].view(np.int64), "name": name[at].view(np.int64), "n": np.diff(np.append(at, len(of)))})

    return step


def _isin(x: np.ndarray, wanted) -> np.ndarray:
    return np.isin(x.view(np.int64), wanted) if wanted is not None and len(wanted) else np.zeros(len(x), bool)


def _tell_apart(window: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d1, text, wanted in zip(pdf["d1"].tolist(), _bytes(pdf["t"]), pdf["apart"], strict=True):
                for raw, begin, _, _ in _pieces([text], window):
                    units = Units(raw, begin, window)
                    which = np.flatnonzero(_isin(units.name, wanted))
                    for k in range(0, len(which), 4096):
                        unit, _, h = units.windows(which[k : k + 4096])
                        yield pd.DataFrame({"d1": d1, "core": units.core[unit].view(np.int64), "h": h.view(np.int64)})

    return step


def _remove(window: int, digest: bool):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, names, cores, hashes in zip(_bytes(pdf["t"]), pdf["names"], pdf["cores"], pdf["hashes"], strict=True):
                cover = np.zeros(len(text) + 1, np.int32)
                for raw, begin, _, offset in _pieces([text], window):
                    units, o = Units(raw, begin, window), int(offset[0])
                    whole = _isin(units.name, names)
                    np.add.at(cover, units.first[whole] + o, 1)
                    np.add.at(cover, units.final[whole] + window + o, -1)
                    _, at, h = units.windows(np.flatnonzero(~whole & _isin(units.core, cores)))
                    at = at[_isin(h, hashes)] + o
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            got = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])
            got.insert(0, "d2", pdf["d2"].to_numpy())
            got.insert(0, "d1", pdf["d1"].to_numpy())
            yield got

    return step


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row of ``df``, kept being bytes; with ``digest``, kept_sha256 in their place.

    Units are dealt by their core. A text is known in the tables by one 64-bit hash, which only says which units to look for in it; whole texts are shuffled only where a bitmap of bounded size says that they may have any.
    """
    if window < 3 * TRIGGER:
        raise ValueError(f"a window has {3 * TRIGGER} bytes at least")
    spark = df.sparkSession
    small_batches(spark, "8m")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("d1", F.xxhash64("t")).withColumn("d2", F.xxhash64(F.lit("other"), "t"))
    long_ = docs.filter(F.octet_length("t") >= window)
    one = lambda some: long_.filter(some(F.col("d1"))).groupBy("d1", "d2").agg(F.first("t").alias("t"))

    # 1. Units, and those whose core occurs twice.
    filed = Table(long_.select("t", "d1").mapInPandas(_file(window), "d1 long, core long, name long, n int"))
    shared = filed.read().groupBy("core").agg(F.sum("n").alias("m")).filter("m > 1").select("core")
    met = cut(filed.read().join(shared, "core"))
    filed.drop()
    del shared
    release(spark)

    # 2. The dictionary of these: how often each occurs, and whether others share its core. Where one occurs once and others are like it, all of the core take part in step 3, each from one text.
    units = met.groupBy("core", "name").agg(F.sum("n").alias("m"), F.min("d1").alias("home"))
    cores = units.groupBy("core").agg(((F.count("*") > 1) & (F.min("m") == 1)).alias("mixed"))
    units = units.join(cores, "core").filter("m > 1 or mixed")
    found = met.join(units, ["core", "name"]).select("d1", F.when(F.col("m") > 1, F.col("name")).alias("whole"), F.when(F.col("mixed") & (F.col("d1") == F.col("home")), F.col("name")).alias("apart"))
    found = cut(found.groupBy("d1").agg(F.collect_set("whole").alias("names"), F.collect_set("apart").alias("apart")))
    del met, units, cores
    release(spark)

    # 3. Windows of units that share a core only.
    apart = found.filter(F.size("apart") > 0).select("d1", "apart")
    table = Table(one(_likely(apart)).join(apart, "d1").select("d1", "t", "apart").mapInPandas(_tell_apart(window), "d1 long, core long, h long"))
    release(spark)
    repeated = table.read().groupBy("core", "h").agg(F.count("*").alias("m")).filter("m > 1").select("core", "h")
    marks = table.read().join(repeated, ["core", "h"]).groupBy("d1").agg(F.collect_set("core").alias("cores"), F.collect_set("h").alias("hashes"))
    marks = cut(found.filter(F.size("names") > 0).select("d1", "names").join(marks, "d1", "full"))
    table.drop()
    del found, apart, repeated
    release(spark)

    # 4. Back to the texts. Those with copies lose all bytes, if they have a window.
    done = one(_likely(marks)).join(marks, "d1").select("d1", "d2", "t", "names", "cores", "hashes")
    done = done.mapInPandas(_remove(window, digest), f"d1 long, d2 long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    twins = docs.groupBy("d1", "d2").agg(F.count("*").alias("copies")).filter("copies > 1").select("d1", "d2", F.lit(True).alias("twin"))
    whole = F.sha2("t", 256) if digest else F.col("t").cast("binary")
    parts = docs.select("id", "d1", "d2", F.octet_length("t").cast("long").alias("n_bytes"), whole.alias("whole"))
    got = parts.join(twins, ["d1", "d2"], "left").join(done, ["d1", "d2"], "left")
    gone = F.col("twin").isNotNull() & (F.col("n_bytes") >= window)
    nothing = F.sha2(F.lit(""), 256) if digest else F.lit("").cast("binary")
    return got.select(
        "id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256" if digest else "kept"),
    )
