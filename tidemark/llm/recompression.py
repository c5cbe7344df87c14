"""Substring dedup by recompression.

Rounds name runs and pairs of symbols, beginning with words. A name is a hash of what it stands for, so it is the same
everywhere in the corpus without a table of names: first runs of equal words, then, in each further round, pairs of a left and a right symbol, the sides
being drawn from the names anew in each round. Equal passages thus get equal symbols inside; how far from a symbol the
words reach that it depends on is carried along, so it is known which symbols a window of ``window`` words has whatever stands around it.

1. Every window is filed under one of the high-level symbols that are certain in it: the one whose words, with those it depends on, hash lowest.
   Neighbouring windows share it, so there are few for many words. Equal windows are always filed alike.
2. Symbols that occur in one place only are let go, and all their windows with them. Only the others' windows are verified, by the
   hash of all their words, counted over the whole corpus.
3. Words that a repeated window covers are removed.

Copies of a whole text are told by its digest and weigh nothing: all their windows repeat, and one of them stands for all in the search.

Defined results: null texts have no words; a text with fewer words than a window loses none; words are compared as they are, by 64-bit hashes, windows by
the key that they are filed under and a 64-bit hash over these, and in the removal by the latter alone; equal rows count as different places; a null id is an id like any other; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Table, cut, release, small_batches

WINDOW = 35
ROUNDS = 4  # of pairs, after the one of runs
MOST = (2, 2, 4, 4, 8)  # words in a symbol after each round
_CHUNK = 1 << 20  # bytes of text that are parsed together
_FAR = 1 << 20
_U = np.uint64
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))


class _Powers:
    """base ** i and base ** -i modulo 2 ** 64, for as many i as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(int(base), _Powers(base)).to(n)


class _Ranges:
    """Hashes of ranges of a sequence."""

    def __init__(self, x: np.ndarray, base: np.uint64):
        up, self.down = _powers(base, len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of some texts, one after the other: hashes, the bytes they stand in, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        raw = b" " + b" ".join(texts) + b" "
        self.raw = np.frombuffer(raw, np.uint8)
        space = _SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.start)
        sizes = np.array([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, 1 + np.cumsum(sizes) - sizes)  # of each text
        self.count = np.diff(np.append(self.first, n))
        self.hash = np.zeros(0, np.uint64)
        if n:
            size = self.end - self.start
            up, _ = _powers(_BASE, int(size.max()) + 1)
            letters = np.flatnonzero(~space)
            at = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
            total = np.add.reduceat(_byte_table()[self.raw[letters]] * up[at], np.cumsum(size) - size)
            self.hash = _mix(total + size.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)


def parse(words: Words, rounds: int = ROUNDS, most: tuple[int, ...] = MOST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each round, its symbols: name, first word, and how many words before and after the symbol it depends on (``_FAR``: more than any)."""
    n = len(words)
    pos = np.arange(n)
    begin = np.zeros(n + 1, bool)  # whether a text begins here
    begin[words.first[words.first < n]] = True
    begin[n] = True
    name = words.hash
    # Runs of at most most[0] words. What is left alone depends on the words on both sides being different.
    same = np.zeros(n + 1, bool)
    if n > 1:
        same[1:n] = (name[1:] == name[:-1]) & ~begin[1:n]
    head = np.flatnonzero(~same[:n])
    size = np.diff(np.append(head, n))
    short = size <= most[0]
    keep = ~same[:n] | np.repeat(~short, size)
    at = np.flatnonzero(keep)
    length = np.diff(np.append(at, n))
    run_at = np.repeat(np.arange(len(head)), size)[at]
    before, after = at - head[run_at], head[run_at] + size[run_at] - at - length
    left = np.where(begin[head[run_at]], _FAR, before + 1)
    right = np.where(begin[head[run_at] + size[run_at]], _FAR, after + 1)
    long_ = ~short[run_at]
    left, right = np.where(long_ & (before >= most[0]), most[0], left), np.where(long_ & (after >= most[0]), most[0], right)
    name = np.where(length > 1, _mix(name[at] * _BASE + length.astype(np.uint64)), name[at])
    pos = at
    out = [(name, pos, left, right)]
    for k in range(1, rounds + 1):
        m = len(pos)
        length = np.diff(np.append(pos, n))
        first = begin[pos]
        last = np.append(first[1:], True) if m else first
        rightish = (_mix(name + _U(k * int(_BASE2) % (1 << 64))) & _U(1)).astype(bool)
        nxt, prv = np.minimum(np.arange(m) + 1, max(m - 1, 0)), np.maximum(np.arange(m) - 1, 0)
        merges = ~rightish & ~last & rightish[nxt] & (length + length[nxt] <= most[k])
        second = np.zeros(m, bool)
        second[1:] = merges[:-1]
        # Alone: a left symbol depends on its right neighbour, a right one on its left, unless it is too long to merge with any.
        full = length >= most[k]
        on_right, on_left = ~rightish & ~full, rightish & ~full
        l2 = np.where(on_right, np.maximum(left, left[nxt] - length), left)
        r2 = np.where(on_right, np.where(last, _FAR, np.maximum(right, length[nxt] + right[nxt])), right)
        l2 = np.where(on_left, np.where(first, _FAR, np.maximum(left, length[prv] + left[prv])), l2)
        r2 = np.where(on_left & ~first, np.maximum(right, right[prv] - length), r2)
        # Pairs depend on what both parts depend on.
        l2 = np.where(merges, np.maximum(left, left[nxt] - length), l2)
        r2 = np.where(merges, np.maximum(right[nxt], right - length[nxt]), r2)
        named = np.where(merges, _mix(name * _BASE ^ _mix(name[nxt] * _BASE2 + _U(k))), name)
        stay = ~second
        name, pos, left, right = named[stay], pos[stay], np.minimum(l2[stay], _FAR), np.minimum(r2[stay], _FAR)
        out.append((name, pos, left, right))
    return out


def window_starts(words: Words, window: int = WINDOW) -> np.ndarray:
    """The first word of each window, which never goes over a text's end."""
    stop = np.repeat(words.first + words.count, words.count) if len(words) else np.zeros(0, int)
    return np.flatnonzero(np.arange(len(words)) + window <= stop)


def window_keys(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, the key it is filed under, and where (the first word of the symbol with all it depends on)."""
    n, s = len(words), window_starts(words, window)
    key, where = np.full(len(s), ~_U(0)), np.full(len(s), -1)
    if not len(s):
        return s, key, where
    ranges = _Ranges(words.hash, _BASE2)
    todo = np.arange(len(s))
    levels = parse(words)
    for name, pos, left, right in (levels[-1], levels[2]):
        length = np.diff(np.append(pos, n))
        a, b = pos - left, pos + length + right
        usable = np.flatnonzero(b - a <= window)
        if not len(usable):
            continue
        pos, a, b = pos[usable], a[usable], b[usable]
        hashes = _mix(ranges.of(a, b) ^ name[usable])
        at = np.searchsorted(pos, s[todo])
        open_ = np.arange(len(todo))
        best, place = np.full(len(todo), ~_U(0)), np.full(len(todo), -1)
        while True:
            open_ = open_[at[open_] < len(pos)]
            open_ = open_[pos[at[open_]] < s[todo[open_]] + window]
            if not len(open_):
                break
            i, w = at[open_], s[todo[open_]]
            better = (a[i] >= w) & (b[i] <= w + window) & (hashes[i] < best[open_])
            hit = open_[better]
            best[hit], place[hit] = hashes[i[better]], a[i[better]]
            at[open_] += 1
        found = place >= 0
        key[todo[found]], where[todo[found]] = best[found], place[found]
        todo = todo[~found]
        if not len(todo):
            break
    if len(todo):  # a window without a certain symbol is filed by itself
        key[todo], where[todo] = ranges.of(s[todo], s[todo] + window), s[todo]
    return s, key, where


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _CHUNK:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _bytes(col: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in col]


def _file(window: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # a text is filed once in a task
        for pdf in batches:
            new = [not (k in seen or seen.add(k)) for k in zip(pdf["d1"].tolist(), pdf["d2"].tolist(), strict=True)]
            pdf = pdf[new]
            texts, d1, d2 = _bytes(pdf["t"]), pdf["d1"].to_numpy(), pdf["d2"].to_numpy()
            for i, j in _chunks(texts):
                words = Words(texts[i:j])
                s, key, where = window_keys(words, window)
                if not len(s):
                    continue
                doc = np.searchsorted(words.first, s, side="right") - 1
                new = np.ones(len(s), bool)  # windows of one symbol are neighbours, or nearly
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (where[1:] != where[:-1])
                got = pd.DataFrame({"doc": doc[new], "key": key[new].view(np.int64), "where": where[new]}).drop_duplicates()
                got = got.groupby(["doc", "key"], sort=False).size().reset_index(name="n")
                at = got["doc"].to_numpy() + i
                yield pd.DataFrame({"d1": d1[at], "d2": d2[at], "key": got["key"].to_numpy(), "twice": got["n"].to_numpy() > 1})

    return step


def _verify(window: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, wanted = _bytes(pdf["t"]), list(pdf["keys"])
            for i, j in _chunks(texts):
                words = Words(texts[i:j])
                s, key, _ = window_keys(words, window)
                if not len(s):
                    continue
                doc = np.searchsorted(words.first, s, side="right") - 1
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                ok = np.zeros(len(s), bool)
                for d in range(j - i):
                    ok[edge[d] : edge[d + 1]] = np.isin(key[edge[d] : edge[d + 1]].view(np.int64), wanted[i + d])
                s, key = s[ok], key[ok]
                h = _Ranges(words.hash, _BASE).of(s, s + window)
                at = doc[ok] + i
                yield pd.DataFrame({"d1": pdf["d1"].to_numpy()[at], "d2": pdf["d2"].to_numpy()[at], "key": key.view(np.int64), "h": h.view(np.int64)})

    return step


def _remove(window: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, marks = _bytes(pdf["t"]), list(pdf["marks"])
            rows: list = []
            for i, j in _chunks(texts):
                words = Words(texts[i:j])
                s = window_starts(words, window)
                mark = _Ranges(words.hash, _BASE).of(s, s + window).view(np.int64)
                doc = np.searchsorted(words.first, s, side="right") - 1
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for k, d in enumerate(range(i, j)):
                    first, n = int(words.first[k]), int(words.count[k])
                    hit = s[edge[k] : edge[k + 1]][np.isin(mark[edge[k] : edge[k + 1]], marks[d])] - first
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + window, -1)
                    gone = np.cumsum(cover)[:n] > 0
                    kept = b" ".join([w for w, g in zip(texts[d].split(), gone.tolist(), strict=True) if not g])
                    rows.append((int(gone.sum()), kept.decode()))
            got = pd.DataFrame(rows, columns=["n_removed", "kept"])
            got.insert(0, "d2", pdf["d2"].to_numpy())
            got.insert(0, "d1", pdf["d1"].to_numpy())
            yield got

    return step


BITS = 1 << 27  # of the filter: 16 MB at most, whatever the corpus


def _likely(df: DataFrame):
    """A filter for the texts of df(d1): true for all of them and for few others, as a function of a column of longs."""
    at = F.pmod(F.col("d1"), F.lit(BITS))
    bitmaps = df.select(F.bitmap_bucket_number(at).alias("n"), F.bitmap_bit_position(at).alias("p")).groupBy("n").agg(F.bitmap_construct_agg("p").alias("b"))
    shared = df.sparkSession.sparkContext.broadcast({r["n"]: bytes(r["b"]) for r in bitmaps.collect()})  # at most BITS in all

    @F.pandas_udf("boolean")
    def likely(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Buckets count from 1; 0 and below don't occur, as positions are not negative.
        table = np.zeros(BITS // 8 + 4096, np.uint8)
        for n, b in shared.value.items():
            first = max(int(n) - 1, 0) * 4096
            table[first : first + len(b)] = np.frombuffer(b, np.uint8)
        for d in batches:
            x = np.mod(d.to_numpy(np.int64), BITS)
            # Bit positions within a bucket follow (x - 1) modulo the bucket's size, except that 0 is the first of bucket 1.
            y = np.where(x > 0, x - 1, 0)
            yield pd.Series((table[y >> 3] >> (y & 7).astype(np.uint8)) & 1 > 0)

    return likely


def _whole(digest: bool):
    @F.pandas_udf("n_words long, whole string")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            words = [t.encode().split() for t in texts]
            joined = [b" ".join(w) for w in words]
            yield pd.DataFrame({"n_words": [len(w) for w in words], "whole": [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in joined]})

    return whole


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row of ``df``; with ``digest``, kept_sha256 in place of the kept words.

    Whole texts are shuffled only where a bitmap of bounded size says that they may have windows to verify, or to remove.
    """
    spark = df.sparkSession
    small_batches(spark, "8m")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("d1", F.xxhash64("t")).withColumn("d2", F.xxhash64(F.lit("other"), "t"))
    one = lambda some: docs.filter(some(F.col("d1"))).groupBy("d1", "d2").agg(F.first("t").alias("t"))

    # 1. Symbols, and in which texts they are.
    filed = cut(docs.select("t", "d1", "d2").mapInPandas(_file(window), "d1 long, d2 long, key long, twice boolean"))
    places = filed.groupBy("key").agg(F.max("twice").alias("twice"), F.min("d1").alias("a"), F.max("d1").alias("b"))
    shared = places.filter(F.col("twice") | (F.col("a") != F.col("b"))).select("key")
    found = cut(filed.join(shared, "key").groupBy("d1", "d2").agg(F.collect_set("key").alias("keys")))
    del filed, places, shared
    release(spark)

    # 2. The windows that are filed there, each text once, made once and counted.
    table = Table(one(_likely(found)).join(found, ["d1", "d2"]).select("d1", "d2", "t", "keys").mapInPandas(_verify(window), "d1 long, d2 long, key long, h long"))
    del found
    release(spark)
    repeated = table.read().groupBy("key", "h").agg(F.count("*").alias("n")).filter("n > 1").select("key", "h")
    marks = cut(table.read().join(repeated, ["key", "h"]).groupBy("d1", "d2").agg(F.collect_set("h").alias("marks")))
    table.drop()
    del repeated
    release(spark)

    # 3. Back to the texts, where a window is told by the hash of its words. Texts with copies lose all words, if they have a window.
    done = one(_likely(marks)).join(marks, ["d1", "d2"]).select("d1", "d2", "t", "marks").mapInPandas(_remove(window), "d1 long, d2 long, n_removed long, kept string")
    done = done.select("d1", "d2", "n_removed", F.sha2("kept", 256).alias("kept") if digest else F.col("kept"))
    twins = docs.groupBy("d1", "d2").agg(F.count("*").alias("copies")).filter("copies > 1").select("d1", "d2", F.lit(True).alias("twin"))
    parts = docs.withColumn("w", _whole(digest)("t")).select("id", "d1", "d2", "w.n_words", "w.whole")
    got = parts.join(twins, ["d1", "d2"], "left").join(done, ["d1", "d2"], "left")
    all_gone = F.col("twin").isNotNull() & (F.col("n_words") >= window)
    nothing = F.sha2(F.lit(""), 256) if digest else F.lit("")
    return got.select(
        "id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, nothing).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256" if digest else "kept"),
    )
