"""The pipeline against brute force of each of its stages, in plain Python."""

import hashlib

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import slow_lines, words
from tidemark.llm import langid

ENGLISH = "the of and to in that was his with for had you not are but from she which were all we when there can said would each".split()
GERMAN = "der die und von den das mit sich des auf ist im dem nicht ein eine als auch nach wird bei einer um am sind noch wie".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(21)
    rows, shared = [], [" ".join(rng.choice(ENGLISH, 14)) + " and a shared line" for _ in range(4)]
    for i in range(90):
        vocabulary = ENGLISH if i % 3 else GERMAN
        text = "\n".join(" ".join(f"{w}{k % 7 or ''}" for w, k in zip(rng.choice(vocabulary, 30), rng.integers(0, 60, 30), strict=True)) for _ in range(int(rng.integers(1, 5))))
        if i % 6 == 0:
            text += "\n" + shared[i % 4]
        rows.append([i, text, "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 5}", 0])
    for i in range(90, 110):  # near copies: one word of a long text is another
        w = rows[i - 90][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append([i, " ".join(w), None, "hot", 0])
    rows += [[110, rows[5][1], "en", None, 0], [111, rows[5][1], "en", "s1", 0], [112, None, "en", "s1", 0], [113, "", "en", "s1", 0], [114, "12 ... !!", "en", "s1", 0]]
    return [tuple(r) for r in rows]


def slow_near(rows, similar=0.8):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = words(w)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [grams(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or (x | y and len(x & y) >= similar * len(x | y)):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    first = {}
    for a in sorted(range(len(rows)), key=lambda a: rows[a][0]):
        first.setdefault(root(a), rows[a])
    return sorted(first.values(), key=lambda r: r[0])


def slow_mix(rows, cap=3):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        free = total - sum(cap * size[s] for s in full)
        target = {s: float(cap * size[s]) if s in full else w[s] * free / sum(w[x] for x in size if x not in full) for s in size}
        over = {s for s in size if target[s] > cap * size[s]} - full
        if not over:
            break
        full |= over
    out = []
    for s in order:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), len(words(r[1]))))
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest = int(target[s] - epochs * size[s])
        for r in mine:
            n = len(words(r[1]))
            part = min(max(rest, 0), n)
            rest -= n
            copies = int((epochs * n + part) / n + 0.5) if n else 0
            out += [r] * copies
    return out


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs)
    names, _ = model.predict([r[1] for r in rows])
    now = [(r[0], r[1], n, r[3]) for r, n in zip(rows, names, strict=True) if n != "und"]
    assert [r[0] for r in rows if r[0] not in {x[0] for x in now}] == [112, 113, 114]
    stage = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        """As the stages are run: each written and read again."""
        out = stage[name](spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    got = after("language ID", docs)
    assert got.columns == corpus_pipeline.COLUMNS and sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in got.filter("source is not null").collect()) == sorted(x for x in now if x[3])
    plan = stage["language ID"](spark, docs, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each text is scored once
    texts = slow_lines([(r[0], r[1]) for r in now])
    now = [(r[0], texts[r[0]], *r[2:]) for r in now]
    got = after("line dedup", got)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == texts
    now = slow_near(now)
    got = after("SimHash near-dedup", got)
    assert sorted(r["doc_id"] for r in got.collect()) == [r[0] for r in now]
    now = slow_mix(now)
    got = after("mixing sources", got)
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == sorted((r[0], r[1], len(r[1])) for r in now)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path())
    want = []
    for r in now:
        ids = sp.encode(r[1])
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in final.collect()) == sorted(want)


def test_the_whole_run_of_nothing_and_of_repeated_rows(spark, tmp_path):
    """run() over an empty table gives an empty table; rows that are equal in all columns count as copies."""
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = [r for r in corpus() if r[0] < 6]
    spark.createDataFrame(rows * 3, SCHEMA).write.parquet(str(tmp_path / "thrice" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "thrice")).collect()
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows} and all(r["n_tokens"] > 0 for r in got)
