"""What the pipeline's last stage leaves behind in a Python worker, which Spark hands on to the next stage."""

import gc
import hashlib
import random

import pandas as pd
import sentencepiece

import corpus_pipeline
from tidemark.llm import sentencepiece_bpe


def test_an_encoder_keeps_no_more_than_it_is_told():
    path = corpus_pipeline.tokenizer_path()
    model, rng = sentencepiece_bpe.read_model(path), random.Random(7)
    small, plain = sentencepiece_bpe.encoder(model, 40), sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdeéß日 .x", k=rng.randint(1, 12))) for _ in range(10))
        assert small.encode(text) == plain.encode(text)
        assert len(small.young) <= 40 and len(small.old) <= 40 and len(small.fits) <= 160
    assert sentencepiece_bpe.encoder(model, 40) is small
    assert sentencepiece_bpe.encoder(model).cache == sentencepiece_bpe.CACHE


def test_the_collector_works_again_after_the_stage():
    e = sentencepiece_bpe.encoder(sentencepiece_bpe.read_model(corpus_pipeline.tokenizer_path()), 40)
    assert gc.isenabled()
    got = pd.concat(sentencepiece_bpe._digested(e, iter([pd.Series(["a b", None]), pd.Series([""])])))
    assert gc.isenabled()
    assert got["n_tokens"].tolist() == [len(e.encode("a b")), 0, 0] and got["ids_sha256"].iloc[1] == hashlib.sha256(b"").hexdigest()


def test_the_pipeline_bounds_its_cache(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sentencepiece_bpe, "digests", lambda df, path, text_col="text", cache=sentencepiece_bpe.CACHE: seen.append(cache) or df.selectExpr("*", "0 n_tokens", "'' ids_sha256", "'' decoded_sha256"))
    corpus_pipeline.sentencepiece(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert seen == [corpus_pipeline.CUTS] and corpus_pipeline.CUTS < sentencepiece_bpe.CACHE
