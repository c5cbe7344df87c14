"""Line dedup: fuzzy lines by MinHash, in DataFrame operations only.

1. Lines are trimmed and put in lower case, and told by their hash. A line's set is that of its character shingles: ``SHINGLE`` characters (UTF-16 units: those beyond the basic plane are two) from every
   place, for all lines alike; a shorter line is one shingle. Its signature is made of the shingles' hashes: sorted, they are cut into ``BANDS`` parts of
   the hash space, and the first ``ROWS`` hashes from each part's start on are one band, so a band is shared with a probability of J ** ROWS. Lines of
   Jaccard similarity 0.8 share at least one with a probability of 0.98, of 0.9 with 0.9999, of 0.5 with 0.27.
2. Every line that shares a band with others is compared with the band's head by the exact Jaccard similarity of the two sets, and
   distributed union-find joins what is similar. Bands that then still hold several components get a second head, from outside the component of the first.
3. Where a band still holds more than one component, all its lines of different components are compared, in the first band they share. A bitmap
   of ``WORDS`` x 64 bits of either set bounds how many shingles two lines can share: each bit that only one of them has is a shingle that the
   other has not. Pairs that can't be similar by this bound go within the join, so no link within bands is lost, and no rows are made of pairs
   that aren't nearly similar.
4. Of each component one line stays, the first by document id and line number; all others are removed from their documents.

Equal lines are one from the first shuffle on, and are counted before it, so a line that is everywhere weighs little.

Defined results: blank lines are kept and never compared; a null text stays null; an emptied text is an empty string;
rows of equal id and text are one document and get the same result; rows without an id come first; no row is dropped, and
extra columns are kept. Lines and texts are told by 64 bits: of N lines, N * N / 2 ** 65 pairs are expected to be taken for equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Table, cut, fresh, release
from tidemark.llm.components import connected_components

SHINGLE, BANDS, ROWS, SIMILAR = 8, 10, 5, 0.8
WORDS = 32


def normal(line: Column) -> Column:
    return F.trim(F.lower(line))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body, or a function in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(line: Column) -> Column:
    """The hashes of a normalised line's character shingles, one for each place."""

    def of(units: Column) -> Column:  # two bytes a character, so that any shingle is found at once
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(units) - 2 * SHINGLE + 1), F.lit(2))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(units, i, F.lit(2 * SHINGLE))))

    return _let(F.encode(line, "UTF-16BE"), of)


def shingles(line: Column) -> Column:
    """The distinct hashes of a normalised line's character shingles."""
    return F.array_distinct(_hashes(line))


def banded(lines: DataFrame, line: str = "norm", as_: str = "bands") -> DataFrame:
    """``lines`` with the band keys of each normalised line, an array of longs.

    Array functions run in compiled code as long as no lambda holds them, so the steps are columns of their own: the parts' starts are put in among
    the sorted hashes, and where they then stand tells the first hash of each part.
    """
    starts = [-(1 << 63) + j * ((1 << 64) // BANDS) for j in range(BANDS)]
    s, m, ring, at = (fresh(lines, x) for x in ("sorted__", "marked__", "ring__", "at__"))
    got = lines.withColumn(s, F.sort_array(_hashes(F.col(line))))
    got = got.withColumns({m: F.sort_array(F.concat(s, F.array(*map(F.lit, starts)))), ring: F.concat(s, F.slice(s, 1, ROWS - 1))})
    places = F.array(*(F.pmod((F.array_position(m, F.lit(x)) - (j + 1)).cast("int"), F.size(s)) for j, x in enumerate(starts)))  # behind the last is the first
    got = got.withColumn(at, F.array_distinct(places))
    keys = lambda r: F.transform(at, lambda i: F.xxhash64(*(F.get(r, i + k) for k in range(ROWS))))
    return got.select(*lines.columns, _let(F.col(ring), keys).alias(as_))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _mapped(texts: DataFrame) -> DataFrame:
    """texts(line, norm, ...) with n, the number of distinct shingles, the words w0, w1 ... of a bitmap of them, and its number of ones."""
    bits = texts.select("line", F.explode(shingles(F.col("norm"))).alias("h"))
    word = F.shiftrightunsigned("h", 64 - (WORDS - 1).bit_length()).cast("int")
    filled = bits.groupBy("line", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"), F.count("*").alias("n"))
    of = lambda i: F.coalesce(F.max(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{i}")
    words = filled.groupBy("line").agg(F.sum("n").cast("int").alias("n"), F.sum(F.bit_count("bits")).cast("int").alias("ones"), *map(of, range(WORDS)))
    return texts.join(words, "line")


def _may_be_similar(similar: float) -> Column:
    """Whether sets a and b can be similar: a bit that is only a's is a shingle of a's that b has not, and the other way round."""
    both = sum((F.bit_count(F.col(f"aw{i}").bitwiseAND(F.col(f"bw{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("aw0").bitwiseAND(F.col("bw0"))))
    most = F.least(F.col("an") - F.col("aones"), F.col("bn") - F.col("bones")) + both
    return (F.least("an", "bn") >= similar * F.greatest("an", "bn") - 1e-6) & (most * (1 + similar) >= similar * (F.col("an") + F.col("bn")) - 1e-6)


def _side(df: DataFrame, x: str) -> DataFrame:
    """``df`` with its columns named for side ``x`` of a pair."""
    return df.select(*(F.col(c).alias(x if c == "line" else x + c) for c in df.columns))


def _verified(pairs: DataFrame, texts: DataFrame, similar: float, bounded: bool = False) -> DataFrame:
    """pairs(a, b) whose lines are similar; texts as of _mapped. ``bounded``: the pairs have been held against the bound."""
    texts = texts.select("line", "norm", "n") if bounded else texts.drop("bands")
    both = pairs.join(_side(texts, "a"), "a").join(_side(texts, "b"), "b")
    both = both if bounded else both.filter(_may_be_similar(similar))
    # The partition's number keeps the optimizer from putting the sets into the condition, where they were computed for each mention.
    sets = both.select("a", "b", "an", "bn", _hashes(F.col("anorm")).alias("x"), _hashes(F.col("bnorm")).alias("y"), F.spark_partition_id().alias("here"))
    common = F.size(F.array_intersect("x", "y"))  # distinct ones
    return sets.filter(common * (1 + similar) >= similar * (F.col("an") + F.col("bn")) - 1e-6).select("a", "b")


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """found(node, component) with the components joined that the links more(a, b) connect. Only components and links between them go round."""
    more = cut(more)
    if more.isEmpty():
        return found
    lone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti")
    all_ = cut(found.unionByName(lone.select("node", F.col("node").alias("component"))))
    end = lambda x: all_.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = more.join(end("a"), "a").join(end("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    names = connected_components(cut(between)).select(F.col("node").alias("component"), F.col("component").alias("name"))
    got = cut(all_.join(names, "component", "left").select("node", F.coalesce("name", "component").alias("component")))
    release(found.sparkSession)
    return got


def line_classes(table: Table, similar: float = SIMILAR) -> DataFrame:
    """A table of lines (line, norm, bands), each once, to (node, component) of those that are similar to others."""
    spark = table.spark
    # One shuffle by band serves the heads and the join back.
    rows = table.read().select("line", F.explode(F.array_distinct("bands")).alias("band")).repartition("band")
    ends = rows.groupBy("band").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low <> high").select("band", "low")
    shared = cut(rows.join(ends, "band").select("band", "line", "low"))
    release(spark)
    wanted = shared.select("line").distinct()
    texts = cut(_mapped(table.read().select("line", "norm", "bands").join(wanted, "line", "left_semi")))
    pairs = shared.filter("line <> low").select(F.col("line").alias("a"), F.col("low").alias("b")).distinct()
    found = connected_components(cut(_verified(pairs, texts, similar)))
    release(spark)

    def open_bands(found: DataFrame) -> DataFrame:
        """(band, line, component, first) where a band holds several components; first: that of its first head."""
        named = shared.join(found, F.col("line") == F.col("node"), "left").select("band", "line", "low", F.coalesce("component", "line").alias("component"))
        first = F.max(F.when(F.col("line") == F.col("low"), F.col("component")))
        mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), first.alias("first")).filter("lo <> hi").select("band", "first")
        return named.drop("low").join(mixed, "band")

    rest = cut(open_bands(found))
    head = F.struct(F.xxhash64("band", "line").alias("h"), F.col("line").alias("b"), F.col("component").alias("cb"))
    heads = rest.filter("component <> first").groupBy("band").agg(F.min(head).alias("head")).select("band", "head.b", "head.cb")
    pairs = rest.join(heads, "band").filter("component <> cb").select(F.greatest("line", "b").alias("a"), F.least("line", "b").alias("b")).distinct()
    found = _merged(found, _verified(pairs, texts, similar))
    rest = cut(open_bands(found).drop("first").join(texts.drop("norm"), "line"))
    first_shared = F.array_min(F.array_intersect("abands", "bbands")) == F.col("aband")
    met = (F.col("aband") == F.col("bband")) & (F.col("acomponent") < F.col("bcomponent")) & _may_be_similar(similar) & first_shared
    pairs = _side(rest, "a").join(_side(rest, "b"), met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = cut(pairs)
    del rest
    release(spark)
    return _merged(found, _verified(pairs, texts, similar, bounded=True))


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(id, digest, gone) of the documents that lose lines: their numbers from 0. digest: xxhash64 of the text."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    docs = docs.withColumn("digest", F.xxhash64("t"))  # below the explosion, or each line would hash its whole text
    lines = docs.select("id", "digest", F.posexplode(F.split("t", "\n")).alias("pos", "raw"))
    lines = lines.select("id", "digest", "pos", normal(F.col("raw")).alias("norm")).filter("norm <> ''").withColumn("line", F.xxhash64("norm"))
    place = F.struct("id", "digest", "pos")
    distinct = lines.groupBy("line").agg(F.first("norm").alias("norm"), F.min(place).alias("first"), F.max(place).alias("last"))
    table = Table(banded(distinct), "line")
    release(df.sparkSession)
    classes = line_classes(table, similar)
    named = table.read().select("line", "first", "last").join(classes, F.col("line") == F.col("node"), "left").select("line", F.coalesce("component", "line").alias("component"), "first", "last")
    kept = named.groupBy("component").agg(F.min("first").alias("keep"), F.max("last").alias("end")).filter("keep <> end").select("component", "keep")
    doomed = cut(named.join(kept, "component").select("line", "keep"))
    table.drop()
    # Merged: Spark sizes exploded lines as if there were one a document, and could broadcast all of them by way of the driver.
    gone = lines.select("line", "id", "digest", "pos").join(doomed.hint("merge"), "line").filter(~place.eqNullSafe(F.col("keep")))
    return gone.groupBy("id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def deduplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, count_as: str | None = None) -> DataFrame:
    """``df`` with each text's repeated lines removed; with ``count_as``, also how many."""
    base = df.select(*df.columns)
    gone = cut(removed_lines(base, id_col, text_col, similar))
    release(df.sparkSession)
    i, d, g, h = (fresh(base, x) for x in ("id__", "digest__", "gone__", "hash__"))
    gone = gone.select(F.col("id").alias(i), F.col("digest").alias(d), F.col("gone").alias(g))
    rows = base.withColumn(h, F.xxhash64(text_col))
    joined = rows.join(gone, rows[id_col].eqNullSafe(gone[i]) & (F.col(h) == F.col(d)), "left")
    # The places that stay are told by a set, and the text is cut once: linear in a text's lines.
    left = _let(F.split(F.col(text_col), "\n"), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(g)), lambda n: F.get(parts, n)), "\n"))
    text = F.when(F.col(g).isNotNull(), left).otherwise(F.col(text_col))
    count = [F.coalesce(F.size(g), F.lit(0)).cast("long").alias(count_as)] if count_as else []
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in base.columns), *count)
