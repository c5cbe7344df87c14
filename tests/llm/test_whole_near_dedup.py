"""Near-dedup by groups of rows, and up to a Jaccard similarity of 0.8."""

import numpy as np

from tidemark.llm import simhash


def prose(seed, n=120):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n)]


def test_rows_stay_unless_a_near_copy_does(spark):
    a, b, c, d = (" ".join(prose(i)) for i in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, a), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for similar in (None, 0.8):
        got = {tuple(r) for r in simhash.deduplicate(df, similar=similar).collect()}
        assert got == {(None, b), (7, c), (7, d), (8, a)}
        assert simhash.deduplicate(df, similar=similar).count() == 4


def grams(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_go_to_jaccard_eight_tenths(spark):
    rows = []
    for g in range(60):
        w = prose(1000 + g, 100 + g)
        for k in (0, 1, 2, 4):  # words changed, the similarity is from 0.95 down to below 0.7
            v = list(w)
            for j in range(k):
                v[(j + 1) * len(v) // (k + 1)] = f"changed{g}_{k}_{j}"
            rows.append((len(rows), " ".join(v)))
    sets = [grams(t) for _, t in rows]
    want = []
    for g in range(0, len(rows), 4):
        up = list(range(g, g + 4))
        for x in range(4):
            for y in range(x):
                if len(sets[g + x] & sets[g + y]) >= 0.8 * len(sets[g + x] | sets[g + y]):
                    up = [up[y] if u == up[x] else u for u in up]
        want += sorted(set(up))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.deduplicate(df, similar=0.8).collect())
    assert got == want and 60 < len(want) < len(rows)
    assert len(got) < simhash.deduplicate(df).count()
