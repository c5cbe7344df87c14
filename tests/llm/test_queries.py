"""The registered queries: their SQL twins, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from tests.oracle import connect, rows_of_spark, rows_of_sql
from tidemark.llm import queries, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sf_dir, name):
    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.ORACLES[name])


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    sizes = [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
        if n == 2:
            groups = simhash.components(docs, width=5)
            assert groups.select("component_id").distinct().count() == sizes[-1]
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4] > 0
    assert "n_tokens" in docs.columns
