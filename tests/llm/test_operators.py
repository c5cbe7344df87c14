"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, langid, licenses, lines, media, mixing, recompression, sentencepiece_bpe, simhash, surrogates, topk
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, lang string, size long, label string"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(4000))
BASE = " ".join(f"base{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved.", "a", "en", 9, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved.", "a", "en", 9, "x"),
    (3, None, "a", "en", 9, None),
    (4, "", "b", None, 9, "x"),
    (5, " \n\t ", "b", "de", 9, "x"),
    (6, LONG, "b", "de", None, "x"),
    (7, BASE + " and then more", None, "en", 9, "x"),
    (8, "before it " + BASE, None, "en", 9, "x"),
    (8, "before it " + BASE, None, "en", 9, "x"),
    (None, "no id here at all", "c", "fr", 9, "x"),
    (10, "na " * 90, "c", "fr", 9, "x"),
    (11, "... !!! 123", "c", "fr", 9, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def key_of(x):
    return (x is None, x)


# 1


def slow_fingerprint(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, docs):
    got = simhash.fingerprints(docs.select("doc_id", "text")).collect()
    assert all(r["fp"] & (1 << 64) - 1 == slow_fingerprint(r["text"]) for r in got)
    # Spark's own XXH64 has the same seed.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c", 42)


def test_simhash_components(docs, empty):
    got = {(r["id"], r["component_id"]) for r in simhash.components(docs).collect()}
    blank = {(3, 3), (4, 3), (5, 3)}
    assert blank <= got and {(1, 1), (2, 1), (8, 8)} <= got and (None, None) in got
    assert simhash.components(docs).count() == len(ROWS)
    assert simhash.components(empty).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=key_of) == [1, 3, 6, 7, 8, 10, 11, None]


@pytest.mark.parametrize("block", [3, 1024])
def test_links_are_those_of_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(map(int, centres))
    for c in centres[:20]:
        for _ in range(25):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    u = np.array(sorted(fps), np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    want = simhash._roots(len(u), a, b)
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    label = {r["node"]: r["component"] for r in components.connected_components(simhash.links(df, block)).collect()}
    mine = [label.get(int(x), int(x)) for x in u.view(np.int64)]
    assert len(set(zip(want.tolist(), mine, strict=True))) == len(set(want.tolist())) == len(set(mine))


def test_connected_components_of_a_path(spark):
    n = 50
    df = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[100] == got[101] == 100


# 2


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SHELF", 3)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 3]) for i in range(70)]
    v += [(100 + i, v[i][1]) for i in range(12)]  # ties
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (None, [0.0] * 5), (204, [])]
    df = spark.createDataFrame(v + bad, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 6).collect())
    ints = {i: np.floor(64 * np.array(x)).astype(int) for i, x in v}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        best = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:6]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 20).collect()
    assert len(few) == 2


def test_blocks_are_pruned():
    rng = np.random.default_rng(4)
    blocks = []
    for b in range(20):
        m = rng.integers(0, 4, (16, 8)) + (50 if b == 3 else 0)
        blocks.append((np.arange(16) + 16 * b, m, m.max(axis=0), m.min(axis=0)))
    _, ids, scored = topk.search_blocks(np.array([-1]), np.ones((1, 8), np.int64), np.array([topk.LEAST]), blocks, 10)
    assert scored == 1 and set(ids[0] // 16) == {3}


# 3


def line_set(k):
    return frozenset(k[j : j + 8] for j in range(max(1, len(k) - 7)))


def slow_lines(rows):
    occ = {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            n = line.lower().strip(" ")
            if n:
                occ.setdefault(n, []).append((i, p))
    names = list(occ)
    sets = [line_set(n) for n in names]
    up = list(range(len(names)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    groups = {}
    for a, n in enumerate(names):
        groups.setdefault(root(a), []).extend(occ[n])
    gone = {p for g in groups.values() for p in g if p != min(g)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_lines(spark, docs, empty):
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(30):
        text = []
        for j in range(4):
            w = [vocabulary[k] for k in np.random.default_rng(j if i % 2 else 100 * i + j).integers(0, 300, 45)]
            if i % 3 == 0:
                w[int(rng.integers(0, 45))] = "changed"
            text.append(" ".join(w))
        rows.append((i, "\n".join([*text, "", "Short line.", "日本語のとても長い行" * 5])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(df).collect()}
    assert got == slow_lines(rows)
    out = lines.deduplicate_lines(docs, count_as="n")
    assert out.count() == len(ROWS) and out.columns == [*docs.columns, "n"]
    by = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(2, ""), (3, None), (5, " \n\t "), (8, "")} <= by  # the line of 8 is that of 7, nearly
    assert lines.deduplicate_lines(empty).count() == 0


# 4


def test_licenses(spark, docs, empty):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n"
    rows = [(1, mit), (2, "Foo. Released under the MIT License. Bar"), (3, "RELEASED!! UNDER THE MIT LICENSE!!"), (4, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (5, None), (6, "all rights reserved for now")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: [], 4: ["Apache-2.0", "LicenseRef-All-Rights-Reserved"], 5: [], 6: []}
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(empty).count() == 0


# 5


def slow_repeats(rows, window):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[s : s + window]) for s in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_repeats(spark, docs, empty):
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(r[0], r[1]) for r in ROWS]
    for i in range(60):
        w = [f"v{k}" for k in rng.integers(0, 12 if i % 4 == 0 else 400, int(rng.integers(0, 120)))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()[i % 9 : 70 - i % 7]
        if i % 7 == 0:
            w += ["a", "b"] * 30 + ["c"] * 50
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in recompression.remove_repeats(df).collect()), key=repr)
    assert got == slow_repeats(rows, 35)
    assert recompression.remove_repeats(empty).count() == 0


def test_symbols_of_equal_windows_are_equal():
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 4, 300))).encode() for _ in range(40)]
    w = recompression.Words(texts)
    s, key, _ = recompression.window_keys(w)
    all_ = b" ".join(texts).split()
    seen = {}
    for a, k in zip(s.tolist(), key.tolist(), strict=True):
        assert seen.setdefault(tuple(all_[a : a + 35]), k) == k


# 6


def test_mix(spark, docs, empty):
    got = mixing.mix(docs.select("doc_id", "text", "source", "label")).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) < 1
        assert all(r["taken"] <= 3 * r["size"] for r in rows) and rows[0]["target"] <= 3 * rows[0]["source_size"]
    total = sum(len(words(r[1])) for r in ROWS)
    assert abs(sum(rows[0]["target"] for rows in by.values()) - total) < 1e-6
    again = mixing.mix(docs.select("doc_id", "text", "source", "label").repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    clash = mixing.mix(docs)
    assert clash.columns[: len(docs.columns)] == docs.columns and "size_" in clash.columns
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_by_turns(spark):
    rng = np.random.default_rng(9)
    for _ in range(3):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, 8) ** 2)}
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        full, total = set(), sum(sizes.values())
        while True:
            free = total - sum(3 * sizes[s] for s in full)
            share = {s: 3.0 * sizes[s] if s in full else w[s] * free / sum(w[x] for x in sizes if x not in full) for s in sizes}
            over = {s for s in sizes if share[s] > 3 * sizes[s]}
            if not over:
                break
            full |= over
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()
        assert {r["src"]: r["target"] for r in got} == pytest.approx(share)


# 7


def test_media(docs, empty):
    got = media.media_columns(docs.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    texts = Counter((r[0], r[1]) for r in ROWS)
    for r in got:
        raw = next(t or "" for (i, t) in texts if i == r["key"]).encode()
        whole = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert (r["width"], r["height"], r["bits"], r["digest"]) == (576, len(whole) // 576, 8, r["payload_sha256"])
        stored = media.to_png(whole)
        assert media.from_png(stored) == whole and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({(r["shard"], r["offset"]) for r in got}) == len({r["digest"] for r in got})
    assert media.media_columns(empty.select("doc_id", "text")).count() == 0


def test_shards_are_tar_files(docs, tmp_path):
    import io
    import tarfile
    from pathlib import Path

    index, root = media.write_shards(docs.select("doc_id", "text"), "text", "doc_id", f"file://{tmp_path}/shards")
    names = set()
    for p in Path(root.removeprefix("file://")).glob("*.tar"):
        with tarfile.open(p) as t:
            names |= {m.name for m in t.getmembers()}
            assert all(t.extractfile(m).read(8) == media.SIGNATURE for m in t.getmembers())
    assert names == {r["digest"].hex() + ".png" for r in index.collect()}
    assert io


# 8


def test_surrogates(spark, docs, empty):
    text = "Write jo.34@mail7.example.com or call +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.2.3.4, TOKEN = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\". Mrs. Jane Doe met Mr. John Smith. Again: +1 017 555 7713, JO.34@mail7.example.com. Version 2.0, 1,000 in 2024-01-01."
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in surrogates.replace_entities(df, b"k").collect()}
    new = got[1]["text"]
    assert got[1]["text"] == got[2]["text"] and got[3]["text"] is None and got[3]["n_entities"] == 0
    assert got[1]["n_entities"] == 9
    for gone in ("jo.34@mail7", "555-7713", "4111 1111", "10.2.3.4", "9233a8", "Jane", "Smith"):
        assert gone not in new
    assert "Version 2.0, 1,000 in 2024-01-01." in new
    card = re.search(r"card ((?:\d{4} ?){4})", new)[1].replace(" ", "")
    assert int(card[-1]) == surrogates._luhn(card[:-1])
    phones = re.findall(r"\+1[ (\d)-]+\d{4}", new)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    mails = re.findall(r"\S+@\S+?[a-z](?= |\.? )", new)
    assert mails[0].lower().rstrip(".") == mails[1].lower().rstrip(".")
    assert re.search(r"Mrs\. (\w+)", new)[1] in surrogates.GIVEN["latin", "f"] and re.search(r"Mr\. (\w+)", new)[1] in surrogates.GIVEN["latin", "m"]
    assert surrogates.replace_entities(df, b"other").filter("doc_id = 1").first()["text"] != new
    out = surrogates.replace_entities(docs, b"k")
    assert out.count() == len(ROWS) and out.columns == [*docs.columns, "n_entities", "kinds"] and out.filter("n_entities > 0").count() == 0
    assert surrogates.replace_entities(empty, b"k").count() == 0


def test_permutations():
    for size in (1, 2, 10, 97, 1000):
        p = surrogates.Permutation(b"k", "t", size)
        assert sorted(map(p, range(size))) == list(range(size))
    ips = {surrogates.surrogate(b"k", "ip", f"8.8.{i}.{j}") for i in range(20) for j in range(20)}
    assert len(ips) == 400 and not any(x.startswith(("10.", "192.168.")) for x in ips)


@pytest.mark.parametrize("few", [0, 100_000])
def test_names_stay_apart(spark, monkeypatch, few):
    draw = surrogates.name_surrogate
    monkeypatch.setattr(surrogates, "name_surrogate", draw)
    names = ["Ann Lee", "Bob Ray", "Cid Fox"]
    df = spark.createDataFrame([(i, f"Dr. {n} came.") for i, n in enumerate(names * 2)], "doc_id int, text string")
    got = [r["text"] for r in surrogates.replace_entities(df, b"k", few=few).orderBy("doc_id").collect()]
    assert len(set(got)) == 3 and got[:3] == got[3:]
    r = surrogates.Replacer(b"k", {"n|ann lee": 1})
    assert r("Dr. Ann Lee came.")[0] == f"Dr. {draw(b'k', 'ann lee', 'n', 1)} came."


# 9


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    path = tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    e = sentencepiece_bpe.encoder(sentencepiece_bpe.read_model(path))
    rng = np.random.default_rng(10)
    letters = list(" abcdefghiklmnoprstuvz  ▁\n\tABC012éßñ日本😀\x00")
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert e.encode(t) == sp.encode(t)
    got = sentencepiece_bpe.digests(docs, path).collect()
    for r in got:
        ids = sp.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs.select("doc_id", "text"), path), path).collect()
    assert all(r["decoded"] == sp.decode(sp.encode(r["text"] or "")) for r in both)
    assert sentencepiece_bpe.digests(empty, path).count() == 0


# 10


def slow_bits(text, samples, order):
    seen = [Counter() for _ in range(order + 1)]
    for d in samples:
        b = d.encode()
        for i in range(len(b)):
            for j in range(min(order, i) + 1):
                seen[j][b[i - j : i], b[i]] += 1
    contexts = [{} for _ in seen]
    for c, s in zip(contexts, seen, strict=True):
        for (ctx, sym), n in s.items():
            c.setdefault(ctx, {})[sym] = n
    total, b = 0.0, text.encode()
    for i, sym in enumerate(b):
        p = 1 / 256
        for j in range(min(order, i) + 1):
            c = contexts[j].get(b[i - j : i])
            if c:
                t, d = sum(c.values()), len(c)
                p = c[sym] / (t + d) if sym in c else d / (t + d) * p
        total -= np.log2(p)
    return total


def test_code_lengths_are_exact(monkeypatch):
    samples = {"en": ["the cat sat on the mat", "a dog and the cat"], "de": ["der hund und die katze", "eine maus"]}
    m = langid.Model(samples, 3)
    texts = ["the katze", "zzz é", "a", "the cat sat on the mat"]
    got = m.code_lengths([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx([slow_bits(t, samples[x], 3) for x in m.langs], rel=1e-5)
    long = " ".join(texts * 3000)
    whole = m.code_lengths([long.encode()])
    monkeypatch.setattr(langid, "_CELLS", 10_000)
    assert m.code_lengths([long.encode()]) == pytest.approx(whole)


def test_language_id(spark, docs, empty, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predict(t, langid.fit(t)).withColumn("h", langid.held_out(F.col("doc_id"))).filter("h and text rlike '[a-z]{3}'")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 0
    assert got.filter("score < 0 or score > 1").count() == 0
    ids = {r["doc_id"] for r in t.filter(langid.held_out(F.col("doc_id"))).collect()}
    assert ids == {r["doc_id"] for r in t.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    some = langid.predict(docs, langid.fit(docs)).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in some if not re.search(r"[^\W\d_]", r["text"] or ""))
    assert langid.predict(docs, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0
