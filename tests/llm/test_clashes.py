"""Extra columns whose names are those of results or of steps on the way; and features by brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, licenses, lines, media, mixing, recompression, sentencepiece_bpe, simhash, surrogates, topk
from tidemark.llm.queries import tokenizer_path

NAMES = (
    "n_entities kinds licenses license sentence_ids wrapped_ids n_tokens ids_sha256 decoded_sha256 score lang_pred fp digest id component node band line key shelf block group query_id rank floor target taken size source_size "
    "gone gone__ digest__ id__ hash__ own_digest kept_id kept_digest nth t d1 d2 marks keys n a b c q v x ppm spm replaced own_names src s2 key_ range_ copy_ shard offset length feature payload words bands norm at first last low"
).split()
TEXTS = ["Mr John Smith wrote to a@b.example.org", "Released under the MIT License.", None, "", "the same line\nand another line here", "the same line\nother words stand here", "the same line\nother words stand here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES)).repartition(2)


def kept(out, but=()):
    """All extra columns are as they came, but those that the result replaces."""
    rows = out.collect()
    for n in NAMES:
        if n not in but:
            assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows), n
    return rows


def test_extra_columns_stay(spark, docs):
    n = len(TEXTS)
    assert len(kept(langid.predict(docs, langid.fit(docs)), ("lang_pred", "score"))) == n
    assert len(kept(lines.deduplicate_lines(docs))) == n
    assert sorted(r["doc_id"] for r in kept(simhash.deduplicate(docs, similar=0.8))) == [0, 1, 2, 4, 5]
    assert sorted(r["doc_id"] for r in kept(simhash.deduplicate(docs))) == [0, 1, 2, 4, 5]
    assert len(kept(licenses.scan(docs), ("sentence_ids", "wrapped_ids", "licenses", "license"))) == n
    assert len(kept(surrogates.replace_entities(docs, b"k"), ("n_entities", "kinds"))) == n
    assert len(kept(surrogates.replace_entities(docs, b"k", few=0), ("n_entities", "kinds"))) == n
    assert len(kept(sentencepiece_bpe.digests(docs, tokenizer_path()), ("n_tokens", "ids_sha256", "decoded_sha256"))) == n
    assert {"size_", "source_size_", "target_", "taken_"} <= set(mixing.mix(docs).columns) and len(kept(mixing.mix(docs))) == n
    kept(mixing.mixed_documents(docs, whole=True))
    assert simhash.components(docs).count() == recompression.remove_repeats(docs).count() == media.media_columns(docs).count() == n


def test_vectors_with_extra_columns(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-5, 6, (50, 6))
    df = spark.createDataFrame([(i, [float(x) / 64 for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    clash = df.select("*", *(F.lit("x").alias(n) for n in NAMES))
    key = lambda r: (r["query_id"], r["rank"])
    plain, extra = (sorted(map(tuple, sorted(topk.top_k(d, F.col("vec_id") % 20 == 0, 5).collect(), key=key))) for d in (df, clash))
    assert plain == extra and len(plain) == 15


def test_a_floor_needs_smaller_ids(spark, monkeypatch):
    """One vector in most rows: ties go to the smallest ids, and other shelves send next to nothing."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SHELF", 2)
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 10 else [2.0, 1.0]) for i in range(120)], "vec_id long, embedding array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 1, 15).collect()}
    best = [i for i in range(120) if i % 10 == 0] + [i for i in range(2, 120) if i % 10]
    assert [got[1, r][0] for r in range(1, 16)] == best[:15]
    q, blocks = np.array([[64, 0]]), [(np.arange(4) + 100, np.array([[64, 0]] * 4), np.array([64, 0]), np.array([64, 0]))]
    _, ids, scored = topk.search_blocks(np.array([1]), q, np.array([4096]), blocks, 3, np.array([50]))
    assert scored == 0 and (ids == -1).all()


def test_features_by_brute_force(docs):
    got = {r["key"]: r["feature"] for r in media.media_columns(docs.select("doc_id", "text")).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        c, n = Counter(raw), len(raw)
        mean = sum(raw) / n
        spread = math.sqrt(sum((b - mean) ** 2 for b in raw) / n)
        entropy = -sum(k / n * math.log2(k / n) for k in c.values())
        head, *rest = got[i].split(";")
        assert head == f"{media.LINE}x{n // media.LINE}" and n % media.LINE == 0
        said = dict(x.split("=") for x in rest)
        assert float(said["mean"]) == pytest.approx(mean, abs=1e-4) and float(said["std"]) == pytest.approx(spread, abs=1e-4) and float(said["entropy"]) == pytest.approx(entropy, abs=1e-4)
        assert said["tones"] == ",".join(str(sum(k for b, k in c.items() if b // 32 == t)) for t in range(8))
    assert len({got[i] for i in (2, 3)}) == 1 and len({got[i] for i in (5, 6)}) == 1 and got[0] != got[1]
