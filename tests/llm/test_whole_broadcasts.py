"""Tables that an explode has made many times longer don't go by way of the driver, however small Spark takes them for."""

import re

from pyspark.sql import functions as F

from tidemark.llm import lines, simhash

SIZE = "spark.sql.autoBroadcastJoinThreshold"


def exploded(plan: str) -> list[str]:
    """What is exploded below a broadcast, without a shuffle between, by which Spark would learn its size."""
    found, above = [], []
    for line in plan.split("== Initial Plan")[0].splitlines():
        at = re.search(r"[A-Z]\w+", line)
        if at is None:
            continue
        above = [x for x in above if x[0] < at.start()] + [(at.start(), at.group())]
        names = [n for _, n in above if n in ("BroadcastExchange", "Exchange")]
        if at.group() == "Generate" and names and names[-1] == "BroadcastExchange":
            found.append(line.strip())
    return found


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filed_fingerprints_lines_and_bands_are_not_broadcast(spark, monkeypatch):
    """Fingerprints, lines and bands that a shuffle or a file shows to be few, below the limit, and that make many rows each, beyond it."""
    plans = []
    for module in (lines, simhash):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: plans.append((planned(df), df)) or cut(df))
    before = spark.conf.get(SIZE)
    spark.conf.set(SIZE, "200k")
    try:
        texts = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("word "), ((F.col("doc_id") % 2000) * 100 + i).cast("string"))), "\n")
        docs = spark.range(4000).select(F.col("id").alias("doc_id"), texts.alias("text"))
        assert lines.deduplicate_lines(docs.filter("doc_id % 2000 < 15")).filter("text = ''").count() == 15
        assert simhash.deduplicate(docs, similar=0.8).count() == 2000
        assert plans and [x for p, _ in plans for x in exploded(p)] == []  # as first planned
        assert [x for _, df in plans for x in exploded(planned(df))] == []  # as run, when Spark knew the sizes of what was shuffled
    finally:
        spark.conf.set(SIZE, before)
