"""The queries ``opN_*`` of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, importance, langid, licenses, lines, media, mixing, prefix_free, recompression, sentencepiece_bpe, simhash, surrogates, topk
from tidemark.llm.common import cut, small_batches, words_of
from tidemark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_as="n_removed")
    return got.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",")
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), joined("sentence_ids").alias("sentence_ids"), joined("wrapped_ids").alias("wrapped_ids"), joined("licenses").alias("licenses"), F.coalesce("license", F.lit("")).alias("license"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, list(s ORDER BY s) AS ss FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) GROUP BY doc_id),
u AS (SELECT doc_id, list_distinct(flatten(list_transform(ss, lambda s: range(s, s + 35)))) AS gone FROM r),
k AS (SELECT w.doc_id, w.ws, u.gone, CASE WHEN u.gone IS NULL THEN w.ws ELSE list_select(w.ws, list_sort(list_filter(range(1, len(w.ws) + 1), lambda i: NOT list_contains(u.gone, i)))) END AS kept FROM w LEFT JOIN u USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = cut(docs.select("doc_id", "source", words_of(F.col("text")).alias("words")))  # each text is read once
    return mixing.mix(counted, size_col="words").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, ss, 3 * ss AS cap, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (SELECT *, sum(ss) OVER () AS total,
  sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(ss AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (ORDER BY CAST(ss AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM w),
g AS (SELECT *, CAST(w * lft AS DOUBLE) > CAST(cap * w_rest AS DOUBLE) AS ful FROM f),
t AS (SELECT source, ss, CASE WHEN ful THEN CAST(cap AS DOUBLE) ELSE
  CAST(w * (total - sum(CASE WHEN ful THEN cap ELSE 0 END) OVER ()) AS DOUBLE) / CAST(sum(CASE WHEN ful THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM g),
e AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS ep FROM t),
o AS (SELECT d.doc_id, d.size, e.ss, e.target, e.ep, CAST(floor(e.target - CAST(e.ep * e.ss AS DOUBLE)) AS BIGINT) AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target, CAST(ep * size + least(greatest(rest - bef, 0), size) AS BIGINT) AS taken FROM o
"""

def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), b"a key of the query's own")
    return got.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def tokenizer_path() -> str:
    """The public model that the contract of op9 names; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, "4m")
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, "4m")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = langid.predict(docs, langid.fit(docs))
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: The checksum is taken bit by bit, each byte being followed by seven zeros.
OP11_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, low),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, low),
dw AS (SELECT i, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
k AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
c AS (SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, CAST(len(h) / 2 AS BIGINT) + 1),
  lambda i: [CAST((instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, CAST(3988292384 AS BIGINT) * (xor(c, x) & 1)))) % 10000 AS k FROM k),
df AS (SELECT i, k FROM dw JOIN c USING (w)),
s AS (SELECT k, count(*) AS s FROM df GROUP BY 1), t AS (SELECT k, count(*) AS t FROM bw JOIN c USING (w) GROUP BY 1),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(s) FROM s), 0) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS g
  FROM (SELECT unnest(range(0, 10000)) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
w AS (SELECT i, count(*) AS n, CAST(floor(sum(g) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM df JOIN g USING (k) GROUP BY 1),
r AS (SELECT doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (i)),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS nth, sum(CASE WHEN words >= 20 THEN 1 ELSE 0 END) OVER () AS n FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN words >= 20 AND nth <= floor(10 * n / 100.0::DOUBLE) THEN nth END AS rank FROM o
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).withColumnRenamed("id", "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"), flags=flags)


OP13_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM t),
h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS f, CAST(list_sum(bits[1:step]) - bits[step] AS BIGINT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before | f) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & f > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & f > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & f > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & f > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM h, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


QUERIES = {
    "op1_simhash_groups": op1_simhash_groups,
    "op2_exact_topk": op2_exact_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_media_columns": op7_media_columns,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op2_exact_topk": OP2_SQL,
    "op4_license_scan": licenses.oracle(),
    "op5_substring_dedup": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
