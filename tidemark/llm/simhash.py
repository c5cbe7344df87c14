"""SimHash near-dedup with pigeonring filtering.

Fingerprints are made in one pass over the texts, without a shuffle. Links are then sought between distinct
fingerprints only, so copies of a text weigh nothing.

Pigeonring: of a fingerprint's 8 segments of 8 bits, seen as a ring, the differences of two fingerprints at ``d`` <= 3 bits have a
start from which the first l segments differ in at most l * 3 / 8 bits together, for every l: 0, 0, 1, 1, 1, 2, 2, 3. So the first two
segments are equal and of the next three two are: each fingerprint is filed under 8 starts x 3 choices of the segment that may differ, each time by 32 exact bits
of its own. Fingerprints that share an entry are compared by the chain's budgets first and then by the full distance.

An entry with more than ``BLOCK`` fingerprints is split by further exact bits: all differences are in the 32 bits that it leaves open, 3 at the most, so
of their four segments one is equal, and each fingerprint is filed again under each of the four. What still has more is dealt to blocks by a hash, so no task gets more than
two blocks of one entry, and each comparison gives back no more links than keep its fingerprints connected, never all pairs. Entries are counted, not numbered, so
none is ever put in order in one task.

``deduplicate`` can also ask for a Jaccard similarity of the shingle sets, which three bits are far too few for: candidates are then texts that share a
band of MinHashes as well, and all are compared by their exact similarity.

Defined results: null and blank texts have fingerprint 0 and link like any other; a null id is never the smallest unless its whole group has none;
equal rows each get their row; an empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, release, small_batches
from tidemark.llm.components import connected_components

DISTANCE, SEGMENTS, WIDTH = 3, 8, 8
BUDGETS = [n * DISTANCE // SEGMENTS for n in range(1, SEGMENTS + 1)]
BLOCK = 1024  # fingerprints of one entry that meet in a task
_STEP = 1 << 16
#: MinHash for candidates of a Jaccard similarity: texts of 0.8 share a band with a probability of 1 - (1 - 0.8**4)**16, 0.9998.
MIN_BANDS, MIN_ROWS = 16, 4
WORDS = 32  # of the bitmap that bounds how many shingles two texts can share
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, MIN_BANDS * MIN_ROWS), dtype=np.uint64)


def _hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The shingles' XXH64, repeats included; none of a text without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(1, len(words) - width + 1))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it."""
    return _majority(_hashes(text, width, seed))


def fingerprints(df: DataFrame, text_col: str = "text", width: int = 3, seed: int = 42, as_: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of every whole text, as a long."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got = np.array([fingerprint(t if isinstance(t, str) else None, width, seed) for t in texts], np.uint64)
            yield pd.Series(got.view(np.int64))

    return df.withColumn(as_, simhash(F.col(text_col)))


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _entries() -> list[tuple[int, int, list[int]]]:
    """(start, mask, masks of the four segments that are left open) of each of the 24 ways to file a fingerprint."""
    out = []
    of = lambda s: ((1 << WIDTH) - 1) << (WIDTH * s)
    for start in range(SEGMENTS):
        for free in (2, 3, 4):
            kept = [(start + k) % SEGMENTS for k in range(5) if k != free]
            out.append((start, _as_long(sum(map(of, kept))), [_as_long(of(s)) for s in range(SEGMENTS) if s not in kept]))
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _within(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chains from ``start`` keep their budgets, and so the whole distance too."""
    x = a ^ b
    s = (start * WIDTH).astype(np.uint64)
    x = (x >> s) | (x << ((np.uint64(64) - s) & np.uint64(63)))  # the start's segment first
    ok = np.ones(len(x), bool)
    for n, most in enumerate(BUDGETS, 1):
        if n in (2, 5, 7, 8):  # the others are implied
            mask = np.uint64((1 << (WIDTH * n)) - 1 if n < SEGMENTS else 0xFFFFFFFFFFFFFFFF)
            ok &= _popcount(x & mask) <= most
    return ok


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _compare(group: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``: each linked fingerprint with its component's first in the run."""
    n = len(fp)
    pa, pb, held = [], [], 0
    label = np.arange(n)

    def merge() -> None:
        nonlocal pa, pb, held, label
        if held:
            label = _roots(n, np.concatenate([*pa, np.arange(n)]), np.concatenate([*pb, label]))
        pa, pb, held = [], [], 0

    rows = np.arange(n)
    for shift in range(1, n):
        rows = rows[: np.searchsorted(rows, n - shift)]
        rows = rows[group[rows] == group[rows + shift]]
        if not len(rows):
            break
        hit = rows[_within(fp[rows], fp[rows + shift], start[rows])]
        if len(hit):
            pa.append(hit)
            pb.append(hit + shift)
            held += len(hit)
            if held > 1_000_000:
                merge()
    merge()
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (entry, value, part, bits, i, j, fp, start); a run that goes over a batch's end waits for the next."""
    keys = ["entry", "value", "part", "bits", "i", "j"]
    rest: pd.DataFrame | None = None

    def out(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[keys].to_numpy()
        group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
        a, b = _compare(group, pdf["fp"].to_numpy().view(np.uint64), pdf["start"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(axis=1))
        head = int(last[-1]) + 1 if len(last) else 0
        rest = pdf.iloc[head:].reset_index(drop=True)
        if head:
            yield out(pdf.iloc[:head])
    if rest is not None and len(rest):
        yield out(rest)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """fps(fp), distinct, to (a, b): links enough to connect all that are at most three bits apart, directly or by others."""
    entries = _entries()
    filed = F.array(*(F.struct(F.lit(n).cast("byte").alias("entry"), F.lit(s).cast("byte").alias("start"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for n, (s, m, _) in enumerate(entries)))
    rows = fps.select("fp", F.explode(filed).alias("e")).select("fp", "e.*")
    # Merged: Spark sizes exploded rows as if there were one for each fingerprint, and would broadcast all of them by way of the driver.
    counts = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").hint("merge")
    rows = rows.join(counts(rows, "entry", "value"), ["entry", "value"])
    zero = F.lit(0).cast("long")
    few = rows.filter(F.col("n") <= block).select("entry", "value", zero.cast("int").alias("part"), zero.alias("bits"), "start", "fp", F.lit(1).cast("long").alias("blocks"))
    open_ = F.get(F.array(*(F.array(*map(F.lit, masks)) for _, _, masks in entries)), F.col("entry").cast("int"))
    many = rows.filter(F.col("n") > block).select("entry", "value", "start", "fp", F.posexplode(F.transform(open_, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "bits"))
    many = many.join(counts(many, "entry", "value", "part", "bits"), ["entry", "value", "part", "bits"])
    many = many.select("entry", "value", (F.col("part") + 1).alias("part"), "bits", "start", "fp", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    met = few.unionByName(many).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    keys = ["entry", "value", "part", "bits", "i", "j"]
    met = met.select("entry", "value", "part", "bits", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", F.col("start").cast("long").alias("start"))
    met = met.repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInPandas(_links, "a long, b long").distinct()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) of every row of ``df``: the smallest id that links reach, the row's own included."""
    rows = cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", width, seed).select("id", "fp"))
    first = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    linked = connected_components(links(first.select("fp")))  # (node, component), of linked fingerprints only
    named = first.join(linked, first["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")


def _min_bands(hashes: np.ndarray) -> list[int]:
    """The band keys of a set of hashes; texts without words share theirs."""
    if not len(hashes):
        return [0]
    least = np.array([(hashes * (m | np.uint64(1)) + c).min() for m, c in _MIX.T])
    return [xxhash.xxh64_intdigest(least[i * MIN_ROWS : (i + 1) * MIN_ROWS].tobytes(), i) for i in range(MIN_BANDS)]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` x 64 bits of a set of hashes."""
    out, at = np.zeros(WORDS, np.uint64), hashes >> np.uint64(64 - (WORDS * 64 - 1).bit_length())
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _signed(df: DataFrame, width: int, banded: bool) -> DataFrame:
    """df(id, t) to (id, digest, fp, n, bands, bits, ones): n distinct shingles; no bands and bits unless ``banded``."""
    small_batches(df.sparkSession)

    @F.pandas_udf("fp long, n int, bands array<long>, bits array<long>, ones int")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = _hashes(t if isinstance(t, str) else None, width)
                fp, h = _majority(h), np.unique(h)
                bits = _bitmap(h) if banded else np.zeros(0, np.uint64)
                rows.append((np.array([fp], np.uint64).view(np.int64)[0], len(h), np.array(_min_bands(h) if banded else [], np.uint64).view(np.int64), bits.view(np.int64), int(np.bitwise_count(bits).sum())))
            yield pd.DataFrame(rows, columns=["fp", "n", "bands", "bits", "ones"])

    return df.select("id", F.xxhash64("t").alias("digest"), sign("t").alias("s")).select("id", "digest", "s.*")


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """pairs(a, b) whose texts are similar by the exact Jaccard similarity; texts(digest, t)."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        sets = lambda t: np.unique(_hashes(t if isinstance(t, str) else None, width))
        return pd.Series([_jaccard(sets(x), sets(y)) >= similar for x, y in zip(left, right, strict=True)], dtype=bool)

    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("digest").alias("b"), F.col("t").alias("tb")), "b")
    return both.filter(alike("ta", "tb")).select("a", "b")


def _near(rows: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """(node, component) of the texts that are similar to others; rows as of _signed, texts(digest, t) with repeats.

    As in line dedup: members of a band are compared with its first, then with one from outside the first's component, and only where a band then
    still holds several components are those compared in pairs, in the first band they share, if a bitmap's bound lets them be similar.
    """
    spark = rows.sparkSession
    distinct = cut(rows.groupBy("digest").agg(F.first("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "bands", "bits", "ones"))))
    filed = distinct.select("digest", "n", F.explode(F.array_distinct("bands")).alias("band"))
    ends = filed.groupBy("band").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("band", "low")
    shared = cut(filed.join(ends.hint("merge"), "band").select("band", "digest", "n", "low"))  # merged for what links() says
    # Fingerprints within DISTANCE are candidates too: each text and the first of its fingerprint, and the firsts of linked ones.
    firsts = distinct.groupBy("fp").agg(F.min("digest").alias("low"))
    same = distinct.join(firsts, "fp").filter("digest <> low").select(F.col("digest").alias("a"), F.col("low").alias("b"))
    ends = firsts.withColumnsRenamed({"fp": "a", "low": "la"}), firsts.withColumnsRenamed({"fp": "b", "low": "lb"})
    close = links(distinct.select("fp").distinct()).join(ends[0], "a").join(ends[1], "b").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b"))
    first = cut(shared.filter("digest <> low").select(F.col("digest").alias("a"), F.col("low").alias("b")).unionByName(same).unionByName(close).distinct())
    release(spark)
    wanted = shared.select("digest").unionByName(first.select(F.col("a").alias("digest"))).unionByName(first.select(F.col("b").alias("digest"))).distinct()
    texts = cut(texts.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("t").alias("t")))
    found = connected_components(cut(_alike(first, texts, width, similar)))
    release(spark)
    merged = lambda found, more: connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    def open_bands(found: DataFrame) -> DataFrame:
        """(band, digest, component, first) where a band holds several components; first: that of its first member."""
        named = shared.join(found, F.col("digest") == F.col("node"), "left").select("band", "digest", "low", F.coalesce("component", "digest").alias("component"))
        head = F.max(F.when(F.col("digest") == F.col("low"), F.col("component")))
        mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), head.alias("first")).filter("lo <> hi").select("band", "first")
        return named.drop("low").join(mixed, "band")

    rest = cut(open_bands(found))
    head = F.struct(F.xxhash64("band", "digest").alias("h"), F.col("digest").alias("b"), F.col("component").alias("cb"))
    heads = rest.filter("component <> first").groupBy("band").agg(F.min(head).alias("head")).select("band", "head.b", "head.cb")
    pairs = rest.join(heads, "band").filter("component <> cb").select(F.greatest("digest", "b").alias("a"), F.least("digest", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = cut(_alike(pairs, texts, width, similar))
    if not more.isEmpty():
        found = cut(merged(found, more))
    release(spark)
    rest = cut(open_bands(found).select("band", "digest", "component").join(distinct.drop("fp"), "digest"))
    left, right = (rest.select(*(F.col(c).alias(x + c) for c in rest.columns)) for x in "ab")
    # Sets whose sizes differ by more can't be similar; nor can those of which a bitmap says that too many shingles are in one only.
    sizes = F.least("an", "bn") >= similar * F.greatest("an", "bn") - 1e-6
    both = F.aggregate(F.zip_with("abits", "bbits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)
    most = F.least(F.col("an") - F.col("aones"), F.col("bn") - F.col("bones")) + both
    bound = most * (1 + similar) >= similar * (F.col("an") + F.col("bn")) - 1e-6
    met = (F.col("aband") == F.col("bband")) & (F.col("acomponent") < F.col("bcomponent")) & sizes & bound & (F.array_min(F.array_intersect("abands", "bbands")) == F.col("aband"))
    pairs = left.join(right, met).select(F.greatest("adigest", "bdigest").alias("a"), F.least("adigest", "bdigest").alias("b")).join(first, ["a", "b"], "left_anti")
    more = cut(_alike(pairs, texts, width, similar))
    return found if more.isEmpty() else merged(found, more)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similar: float | None = None) -> DataFrame:
    """The first row by id and text of each group of near copies; ids play no part in what a group is, and rows without an id come last.

    Near copies are texts whose fingerprints are linked; with ``similar``, those whose sets of shingles have this Jaccard similarity.
    """
    base = df.select(*df.columns)
    plain = base.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = cut(_signed(plain, width, similar is not None))
    if similar is None:
        key, linked = "fp", connected_components(links(rows.select("fp").distinct()))
    else:
        key, linked = "digest", _near(rows, plain.select(F.xxhash64("t").alias("digest"), "t"), width, similar)
    release(df.sparkSession)
    named = rows.select("id", "digest", "fp").join(linked, F.col(key) == F.col("node"), "left").withColumn("group", F.coalesce("component", key))
    first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first"))
    i, d, h, n = (fresh(base, x) for x in ("kept_id", "kept_digest", "own_digest", "nth"))
    keep = cut(first.select(F.col("first.id").alias(i), F.col("first.digest").alias(d)))
    marked = base.withColumn(h, F.xxhash64(text_col))
    got = marked.join(keep, marked[id_col].eqNullSafe(keep[i]) & (F.col(h) == F.col(d)))
    one = Window.partitionBy(i, d).orderBy(*(F.col(c).cast("string") for c in df.columns))  # rows of equal id and text
    return got.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*df.columns)
