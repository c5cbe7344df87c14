"""The pipeline's mix takes documents whole."""

import corpus_pipeline


def test_no_text_is_cut(spark):
    rows = [(i, "\n".join([f"line {i}", *(f"word{k} and" for k in range(20 + 7 * i))]), "en", "abc"[i % 3], 0) for i in range(40)]
    rows += [(100 + i, t, "en", s, 0) for i, t in enumerate(("", " \n", None)) for s in "abc"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    texts = {r[0]: r[1] for r in rows}
    assert got and all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
