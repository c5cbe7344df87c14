"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts is counted on labelled rows and then frozen. A byte is coded
in the longest context of at most ``ORDER`` bytes; where a language has not seen it there, it pays for an escape (method C:
distinct followers / (followers + distinct followers)) and the next shorter context is asked, down to a uniform byte. A text's code length under
a language is the exact sum over all its bytes; the language with the shortest code is predicted.

The trees of all languages are merged into one automaton whose nodes hold one code length for each language, escapes
included, so that a whole batch of texts is scored by ``ORDER`` + 1 table look-ups a byte, for all languages at once.

Bounds: training reads at most ``max_docs`` rows a language, chosen by a hash of the id, each over its whole text; ``max_langs`` is the
most languages that are learned, those of most rows first. Their byte strings are counted by tasks, and only the counts of different ones come to the driver, ``max_grams`` at most: with more, which such a sample of prose doesn't reach, training
stops with a message that says so. No text comes to the driver. Every row is scored, over its whole text.

Defined results: ``und`` with score 0 for null texts and texts without a letter, or if nothing could be learned; ties go to the
language that comes first by name; rows with a null id can't be trained on; equal rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh

ORDER = 4
LETTER = re.compile(r"[^\W\d_]")
_CELLS = 500_000  # positions times languages that are scored at once
_PIECE = 1 << 20  # bytes that are counted at once
MAX_GRAMS = 20_000_000  # different byte strings of all lengths and languages: some 500 MB on the driver


def _grams(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte strings of length k of a text, as integers, and their counts. A long text is counted in pieces."""
    found = []
    for start in range(0, len(text) - k + 1, _PIECE):
        b = np.frombuffer(text[start : start + _PIECE + k - 1], np.uint8).astype(np.int64)
        key = np.zeros(len(b) - k + 1, np.int64)
        for j in range(k):
            key = (key << 8) | b[j : len(b) - k + 1 + j]
        found.append(np.unique(key, return_counts=True))
    return _added(found)


def _added(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their counts."""
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in some]), minlength=len(keys)).astype(np.int64)


def _counts(order: int):
    """Batches of (lang, text) to (lang, k, gram, n)."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for k in range(1, order + 2):
                    gram, n = _grams(text.encode(), k)
                    yield pd.DataFrame({"lang": lang, "k": np.int32(k), "gram": gram, "n": n})

    return step


class Model:
    """The merged, frozen context trees. Node 0 is no node, node 1 the empty context."""

    def __init__(self, samples: dict[str, list[str]] | None, order: int = ORDER, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] | None = None):
        """From texts by language, or from their counts: for each language and length, sorted byte strings and how often each occurs."""
        if counts is None:
            counts = {x: {k: _added([_grams(t.encode(), k) for t in texts]) for k in range(1, order + 2)} for x, texts in (samples or {}).items()}
        self.langs = sorted(counts)
        self.order = order
        n = len(self.langs)
        self.levels: list[np.ndarray] = []  # keys of the nodes of each length from 1, in the order of their ids
        ids = {0: (np.zeros(1, np.int64), np.ones(1, np.int64))}
        value, escape = [np.zeros((2, n), np.float32)], [np.zeros((1, n), np.float32)]
        counted = [counts[x] for x in self.langs]
        first = 2
        for k in range(1, order + 2):
            keys = np.unique(np.concatenate([c[k][0] for c in counted])) if n else np.zeros(0, np.int64)
            count = np.zeros((len(keys), n))
            for j, c in enumerate(counted):
                count[np.searchsorted(keys, c[k][0]), j] = c[k][1]
            above = np.searchsorted(ids[k - 1][0], keys >> 8)  # the context, one byte shorter
            size = len(ids[k - 1][0])
            total, kinds = np.zeros((size, n)), np.zeros((size, n))
            np.add.at(total, above, count)
            np.add.at(kinds, above, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(count / (total + kinds)[above])
            if k == 1:
                lower = np.full((len(keys), n), 8.0)
            else:
                suffix = np.searchsorted(ids[k - 1][0], keys & ((1 << (8 * (k - 1))) - 1))
                lower = self._last[suffix]
            self._last = np.where(count > 0, seen, esc[above] + lower)
            value.append(self._last.astype(np.float32))
            escape.append(esc.astype(np.float32))
            ids[k] = (keys, np.arange(first, first + len(keys)))
            self.levels.append(keys)
            first += len(keys)
        del self._last
        self.value = np.concatenate(value)
        self.escape = np.concatenate(escape)  # of nodes 0 .. the last context
        self._tree()

    def _tree(self) -> None:
        """Followers of every node that can be a context, in the room of their number: 256 bits a node say which bytes follow, and as nodes of
        a level are numbered in the order of their contexts, a follower's number is that of its context's first one and its rank among the bits."""
        inner = 2 + sum(len(x) for x in self.levels[:-1])
        self.follows = np.zeros((inner, 4), np.uint64)
        rank = np.zeros((inner, 4), np.int32)
        first, shorter = 2, (np.zeros(1, np.int64), 1)
        for keys in self.levels:
            node = shorter[1] + np.searchsorted(shorter[0], keys >> 8)
            byte = (keys & 255).astype(np.uint64)
            np.bitwise_or.at(self.follows, (node, byte >> np.uint64(6)), np.uint64(1) << (byte & np.uint64(63)))
            nodes = np.arange(shorter[1], shorter[1] + len(shorter[0]))
            rank[nodes, 0] = first + np.searchsorted(node, nodes)
            shorter, first = (keys, first), first + len(keys)
        counts = np.bitwise_count(self.follows).astype(np.int32)
        rank[:, 1:] = rank[:, :1] + np.cumsum(counts, axis=1)[:, :3]
        self.follows, self.rank = self.follows.reshape(-1), rank.reshape(-1)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node of each context and the byte after it; 0 if there is none."""
        at = node * 4 + (byte >> 6)
        bits, bit = self.follows[at], (byte & 63).astype(np.uint64)
        below = bits & ((np.uint64(1) << bit) - np.uint64(1))
        return np.where((bits >> bit) & np.uint64(1), self.rank[at] + np.bitwise_count(below), 0).astype(np.int32)

    def _piece(self, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code lengths of each byte of the concatenated texts, which begin at ``starts``."""
        child, n = self.child, len(b)
        b = b.astype(np.int32)
        nodes = [np.ones(n, np.int32)]
        for k in range(1, self.order + 2):
            at = np.zeros(n, np.int32)
            if k == 1:
                at = child(nodes[0], b)
            else:
                at[1:] = child(nodes[-1][:-1], b[1:])
                at[starts] = 0
            nodes.append(at)
        cost = self.value[nodes[-1]].astype(np.float64)
        open_ = np.flatnonzero(nodes[-1] == 0)
        for k in range(self.order, -1, -1):
            if not len(open_):
                break
            if k:
                context = np.where(open_ > 0, nodes[k][open_ - 1], 0)
                context[np.isin(open_, starts)] = 0
            else:
                context = np.ones(len(open_), np.int32)
            cost[open_] += self.escape[context]
            if k:
                hit = nodes[k][open_]
                cost[open_] += self.value[hit]
                open_ = open_[hit == 0]
            else:
                cost[open_] += 8.0
        return cost

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        step = max(4096, _CELLS // max(1, len(self.langs)))
        waiting: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal waiting, held
            sizes = np.array([len(texts[i]) for i in waiting])
            starts = np.cumsum(sizes) - sizes
            cost = self._piece(np.frombuffer(b"".join(texts[i] for i in waiting), np.uint8), starts)
            out[waiting] = np.add.reduceat(cost, starts, axis=0)
            waiting, held = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > step:  # in pieces that begin with the bytes before them as context
                b = np.frombuffer(t, np.uint8)
                for s in range(0, len(b), step):
                    lead = min(s, self.order)
                    out[i] += self._piece(b[s - lead : s + step], np.zeros(1, np.int64))[lead:].sum(axis=0)
                continue
            if held + len(t) > step:
                flush()
            waiting.append(i)
            held += len(t)
        if waiting:
            flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ok = [i for i, t in enumerate(texts) if t is not None and self.langs and LETTER.search(t)]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if ok:
            bits = self.code_lengths([texts[i].encode() for i in ok])
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits[np.arange(len(ok)), best][:, None], 1000.0)
            score[ok] = 1.0 / np.exp2(-gap).sum(axis=1)
            for i, k in zip(ok, best, strict=True):
                names[i] = self.langs[k]
        return names, score


def held_out(id_: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 200, max_langs: int = 1000, order: int = ORDER, max_grams: int = MAX_GRAMS) -> Model:
    """Count the trees on at most ``max_docs`` labelled rows a language that are not held out, each over its whole text."""
    usable = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}  # a row a language
    spread = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 32)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * max_docs / n + 1e-4) * 2**32))) if counts else None
    if share is None:
        return Model({}, order)
    picked = (
        usable.withColumn("h", spread)
        .filter((F.col("h") < F.element_at(share, F.col("lang"))) & F.col("text").isNotNull())
        .select("lang", "h", "text")
    )
    first = Window.partitionBy("lang", "text").orderBy("h")
    rank = Window.partitionBy("lang").orderBy("h", "text")
    rows = picked.withColumn("copy", F.row_number().over(first)).filter("copy = 1").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= max_docs).select("lang", "text")
    grams = cut(rows.repartition("lang", F.xxhash64("text")).mapInPandas(_counts(order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))
    many = grams.count()
    if many > max_grams:
        raise ValueError(f"{many} different byte strings in the training sample, more than max_grams = {max_grams}: take fewer documents a language")
    got = grams.orderBy("lang", "k", "gram").toArrow()
    lang, k, gram, n = (got.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "k", "gram", "n"))
    trees: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {x: {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(1, order + 2)} for x in sorted(set(lang.tolist()))}
    edge = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(k)), strict=True):
        trees[lang[a]][int(k[a])] = gram[a:b], n[a:b]
    return Model(None, order, trees)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior (of equal priors); columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def ppm(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names, score = m.predict([None if t is None or t != t else t for t in texts])
            yield pd.DataFrame({"lang": names, "score": score})

    own = fresh(df, "ppm")
    # Not deterministic to the optimizer: else a filter on the prediction is pushed below it and has texts scored twice.
    got = df.withColumn(own, ppm.asNondeterministic()(F.col(text_col)))
    return got.withColumn(lang_as, F.col(f"{own}.lang")).withColumn(score_as, F.col(f"{own}.score")).drop(own)
