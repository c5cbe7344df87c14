"""Prefix-free parsing against brute force over all windows, with periodic, long, repeated, empty and null texts."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import prefix_free, queries


def slow(rows, window):
    """(id, n_bytes, n_removed, n_spans, kept) of each row, from a count of all windows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(t[s : s + window]) for _, t in texts for s in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone, until = bytearray(len(t)), 0
        for s in range(len(t) - window + 1):
            if seen[hash(t[s : s + window])] > 1:
                for k in range(max(s, until), s + window):
                    gone[k] = 1
                until = s + window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2], r[4])


def made(seed):
    rng = random.Random(seed)
    letters = "abcdefgh äöü\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (30, 47, 48, 49, 60, 100, 150, 400, 700)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [text(rng.randrange(80)), s if rng.random() < 0.5 else s[a : a + rng.randrange(20, 500)]]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 500), (103, "ab" * 300), (104, "ab" * 20 + text(50)), (105, "x" * 47), (106, "x" * 48), (7, rows[7][1]), (None, rows[8][1] + "tail"), (107, rows[9][1] * 3), (108, shared[8]), (109, shared[8])]
    return rows


@pytest.mark.parametrize(("seed", "window"), [(1, 48), (2, 48), (3, 100), (4, 400)])
def test_same_as_brute_force(spark, seed, window):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, d1 int, core string").repartition(5)
    got = [tuple(r) for r in prefix_free.remove_repeats(df, window=window).collect()]
    expected = slow(rows, window)
    assert sorted(((i, n, m, s, bytes(k)) for i, n, m, s, k in got), key=key) == sorted(expected, key=key)
    if window == 48:
        assert sum(0 < m < n for _, n, m, *_ in expected) > 20


def test_pieces_do_not_show(spark, monkeypatch):
    """Texts longer than a piece: each window is in one piece, whatever the pieces."""
    rows = [(i, t) for i, t in made(5) if t]
    rows.append((200, "".join(t for _, t in rows[:30])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(prefix_free, "_PIECE", 300)
    for window in (48, 100):
        for texts in ([t.encode() for _, t in rows],):
            starts = [(d, o + s) for raw, begin, doc, offset in prefix_free._pieces(texts, window) for p, (d, o) in enumerate(zip(doc, offset, strict=True)) for s in range((begin.tolist() + [len(raw)])[p + 1] - begin[p] - window + 1)]
            assert sorted(starts) == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - window + 1)]
    monkeypatch.undo()
    got = [tuple(r) for r in prefix_free.remove_repeats(df, window=48).collect()]
    assert sorted(((i, n, m, s, bytes(k)) for i, n, m, s, k in got), key=key) == sorted(slow(rows, 48), key=key)


def test_every_window_is_in_one_unit():
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 101, n, dtype=np.uint8).tobytes() for n in (0, 399, 400, 5000)] + [b"a" * 3000]
    for raw, begin, _, _ in prefix_free._pieces(texts, 400):
        units = prefix_free.Units(raw, begin, 400)
        _, at, _ = units.windows(np.arange(len(units.first)))
        ends = np.append(begin[1:], len(raw))
        assert sorted(at.tolist()) == [s for b, e in zip(begin.tolist(), ends.tolist(), strict=True) for s in range(b, e - 399)]


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op12_suffix_dedup"](spark, sf_dir).collect())
    assert got == sorted((i, n, m, s, hashlib.sha256(k).hexdigest()) for i, n, m, s, k in slow(rows, 400))


def test_empty(spark):
    assert prefix_free.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
