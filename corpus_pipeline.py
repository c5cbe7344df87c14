"""The corpus pipeline: five of the operators for training data, one after the other.

Each stage takes what its predecessor kept, whole, and its decisions take effect. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, lines, mixing, sentencepiece_bpe, simhash
from tidemark.llm.common import cut, small_batches
from tidemark.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Cuts that a Python worker keeps in each generation: it lives on beside the executor's JVM after the stage, when that has grown.
CUTS = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents without a language (no text, no letter) go."""
    small_batches(spark, "2m")
    got = langid.predict(docs.select(*COLUMNS), langid.fit(docs), lang_as="lang", score_as="score__")
    return got.filter("lang <> 'und'").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines, the first in the corpus stays."""
    return _measured(lines.deduplicate_lines(docs.select(*COLUMNS)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard similarity 0.8 or more) stays, the one of the smallest id."""
    return simhash.deduplicate(docs.select(*COLUMNS), similar=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often as the mix takes them."""
    return _measured(mixing.mixed_documents(docs.select(*COLUMNS), whole=True))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    small_batches(spark, "1m")
    return sentencepiece_bpe.digests(docs.select(*COLUMNS), tokenizer_path(), cache=CUTS).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: Learned statistics and merges can't be put in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
