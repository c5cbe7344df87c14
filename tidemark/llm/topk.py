"""Exact top-k search by block-at-a-time pruning.

Vectors of small integers (components scaled and floored) are laid out in document-range blocks: runs of ids, kept as forward indexes, one
matrix a block of the narrowest integers that hold it, with the maximum and minimum of every term (dimension). For a query, the sum over its terms of the
larger of weight x maximum and weight x minimum bounds every score in a block. Blocks are taken in the order of their bounds, best first, and scored through
their forward index until the next bound falls below the k-th best so far. Of equal scores the smaller id is better, so a block whose
bound equals the k-th score is only scored if it has smaller ids than the k-th.

Queries go in groups of ``QUERIES`` and blocks in shelves of ``SHELF`` blocks. A first pass over the shelf of the smallest ids gives each query a floor: the k-th best
that a full answer has at least. Then the bounds alone, without the vectors, meet the queries: only blocks that reach the floor of some query of a group are
sent to that group and scored. A task holds one group and one shelf's part, so memory is bounded by both sizes.

Defined results: vectors that are null or have null, NaN or infinite components take no part, nor do rows without an id, nor do those
whose length is not the usual one (that of most rows; of equal counts the smaller); rows of equal id are different candidates, and as queries share one answer; ties go to the smaller
id; with fewer than k candidates all are given; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches

BLOCK, SHELF, QUERIES = 256, 64, 1024


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): the rows that take part, components turned into floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.filter(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in col])


def _narrow(m: np.ndarray) -> np.ndarray:
    """In the narrowest integers that hold all of it."""
    for kind in (np.int8, np.int16, np.int32):
        if len(m) == 0 or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return m.astype(kind)
    return m


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of ids, to one row a block. The last block of a partition may be short."""
    rest: pd.DataFrame | None = None

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["v"])
        thin = _narrow(m)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"n": [len(m)], "least": [ids.min()], "ids": [ids.tobytes()], "width": [thin.itemsize], "rows": [thin.tobytes()], "high": [m.max(axis=0).tobytes()], "low": [m.min(axis=0).tobytes()]})

    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        while len(rest) >= BLOCK:
            yield pack(rest.iloc[:BLOCK])
            rest = rest.iloc[BLOCK:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield pack(rest)


_PACKED = "n long, least long, ids binary, width int, rows binary, high binary, low binary"


def _merge(best: np.ndarray, ids: np.ndarray, score: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, by score and then by smaller id; missing places have id -1."""
    all_s, all_i = np.concatenate([best, score], axis=1), np.concatenate([ids, new], axis=1)
    # Missing ones last: their scores are the least of all.
    order = np.lexsort((np.where(all_i < 0, np.iinfo(np.int64).max, all_i), -all_s), axis=1)[:, :k]
    return np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)


LEAST = np.iinfo(np.int64).min + 1
MOST = np.iinfo(np.int64).max


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where all sums are below 2**53, which is faster."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if size < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no score of a query (row) in a block (column) is above."""
    return _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)


def search_blocks(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, floor_id: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of the blocks (ids, rows, high, low) for each query, and how many (query, block) were scored. Left out is what is worse than
    ``floor``: lower scores, and equal ones of ids above ``floor_id``.
    """
    n = len(q)
    floor_id = np.full(n, MOST) if floor_id is None else floor_id
    best, ids = np.full((n, k), LEAST), np.full((n, k), -1, np.int64)
    least = np.array([b[0].min() for b in blocks])
    bound = bounds(q, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    scored = 0
    for turn in range(len(blocks)):
        at = order[:, turn]
        top = bound[np.arange(n), at]
        # The k-th best so far, or the floor if that is better; of equal scores the smaller id is.
        own_id = np.where(ids[:, -1] < 0, MOST, ids[:, -1])
        ahead = (best[:, -1] > floor) | ((best[:, -1] == floor) & (own_id < floor_id))
        bar, bar_id = np.where(ahead, best[:, -1], floor), np.where(ahead, own_id, floor_id)
        # Once a query's next bound is below its bar, all later ones are.
        if not (top >= bar).any():
            break
        open_ = np.flatnonzero((top > bar) | ((top == bar) & (least[at] <= bar_id)))
        scored += len(open_)
        for b in np.unique(at[open_]):
            some = open_[at[open_] == b]
            b_ids, rows = blocks[b][0], blocks[b][1]
            score = _product(q[some], rows)
            bar_s, bar_i = bar[some][:, None], bar_id[some][:, None]
            out = (b_ids[None, :] == q_ids[some][:, None]) | (score < bar_s) | ((score == bar_s) & (b_ids[None, :] > bar_i))
            score[out] = LEAST
            keep = min(k, score.shape[1])
            # Of a block, at most k can be among the best; ties by id need whole rows in order.
            top_ = np.lexsort((np.broadcast_to(b_ids, score.shape), -score), axis=1)[:, :keep]
            s = np.take_along_axis(score, top_, 1)
            i = np.where(s == LEAST, -1, b_ids[top_])
            best[some], ids[some] = _merge(best[some], ids[some], s, i, k)
    return best, ids, scored


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.rows, np.dtype(f"i{row.width}")).reshape(len(ids), -1), np.frombuffer(row.high, np.int64), np.frombuffer(row.low, np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``df`` where ``is_query``, its k best other rows by integer inner product."""
    small_batches(df.sparkSession)
    flag = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = usable(flag, "id", "x", scale)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    found = sizes.first()
    dims = found["d"] if found else 0
    total = found["n"] if found else 0
    rows = rows.filter(F.size("v") == dims)
    parts = max(1, -(-total // (BLOCK * SHELF)))
    packed = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInPandas(_blocks, _PACKED)
    at = F.monotonically_increasing_id()
    packed = cut(packed.select("*", at.alias("block"), F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("nth")))
    # Shelves: SHELF blocks each in the order of ids, whatever partitions they are in.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = packed.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    blocks = packed.join(starts, "part").withColumn("shelf", F.floor((F.col("start") + F.col("nth")) / SHELF)).drop("part", "nth", "start")
    count = -(-packed.count() // SHELF)
    asked = cut(usable(flag.filter("q"), "id", "x", scale).filter(F.size("v") == dims).distinct())
    many = max(1, -(-asked.count() // QUERIES))
    queries = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(many)))
    groups = df.sparkSession.range(many).withColumnRenamed("id", "group")
    # Groups x shelves: rows of two numbers. The first pass takes shelf 0, which has the smallest ids.
    first = groups.select("group", F.lit(0).cast("long").alias("shelf"))
    others = groups.select("group", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(count - 1, 1)).cast("long"))).alias("shelf")).filter(F.col("shelf") < count)

    spec = "query_id long, id long, score long"

    def sides(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        """The queries of each (group, shelf), with their floors."""
        q = queries if floors is None else queries.join(floors, "id", "left")
        q = q.withColumns({"floor": F.lit(LEAST) if floors is None else F.coalesce("floor", F.lit(LEAST)), "floor_id": F.lit(MOST) if floors is None else F.coalesce("floor_id", F.lit(MOST))})
        return q.join(pairs, "group").groupBy("group", "shelf")

    def search(pairs: DataFrame, wanted: DataFrame, floors: DataFrame | None) -> DataFrame:
        """pairs(group, shelf), wanted(group, block), floors(id, floor, floor_id)."""

        def task(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(bs):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
            q_ids = qs["id"].to_numpy()
            best, ids, _ = search_blocks(q_ids, _matrix(qs["v"]), qs["floor"].to_numpy(), [_unpack(r) for r in bs.itertuples()], k, qs["floor_id"].to_numpy())
            real = ids >= 0
            return pd.DataFrame({"query_id": np.repeat(q_ids, real.sum(axis=1)), "id": ids[real], "score": best[real]})

        return sides(pairs, floors).cogroup(blocks.join(wanted, "block").groupBy("group", "shelf")).applyInPandas(task, spec)

    def reached(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        """(group, block) of the blocks whose bound reaches the floor of one of the group's queries at least; bounds only are sent."""

        def task(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(bs):
                return pd.DataFrame({"group": np.zeros(0, np.int64), "block": np.zeros(0, np.int64)})
            matrix = lambda c: np.stack([np.frombuffer(x, np.int64) for x in bs[c]])
            top = bounds(_matrix(qs["v"]), matrix("high"), matrix("low"))
            floor, floor_id = qs["floor"].to_numpy()[:, None], qs["floor_id"].to_numpy()[:, None]
            ok = ((top > floor) | ((top == floor) & (bs["least"].to_numpy()[None, :] <= floor_id))).any(axis=0)
            return pd.DataFrame({"group": np.full(int(ok.sum()), qs["group"].iloc[0]), "block": bs["block"].to_numpy()[ok]})

        thin = blocks.select("shelf", "block", "least", "high", "low").join(pairs, "shelf").groupBy("group", "shelf")
        return sides(pairs, floors).cogroup(thin).applyInPandas(task, "group long, block long")

    def best(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    wanted = first.join(blocks.select("shelf", "block"), "shelf").select("group", "block")
    one = cut(best(search(first, wanted, None)))
    floors = one.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"), F.col("id").alias("floor_id")).distinct()
    wanted = cut(reached(others, floors))
    more = search(others, wanted, floors)
    return best(one.select("query_id", "id", "score").unionByName(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
