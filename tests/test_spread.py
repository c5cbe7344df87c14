"""Work that is long for its rows is dealt over tasks, and done once."""

from pyspark.sql import functions as F

from tidemark.operators import simulate as S
from tidemark.plans import catalog


def test_walks_are_dealt_over_tasks(spark, tmp_path):
    """A small file of walks is one split; its folds are of several tasks, with the same walks as one task has."""
    spark.range(40).withColumnRenamed("id", "walk").coalesce(1).write.parquet(str(tmp_path / "w"))
    walks = spark.read.parquet(str(tmp_path / "w"))
    assert walks.rdd.getNumPartitions() == 1
    for got in (S.box_walk(spark, walks, 20, 4.0, 3.0), S.target_walk(spark, walks, 20, 10.0, (3.0, 0.0, 2.0, 2.0))):
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, got.coalesce(1).collect())) and got.count() == 40


def test_panel_is_dealt_over_tasks(spark, sf_dir):
    got = catalog.QUERIES["s20_synthetic_panel"](spark, sf_dir)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_basket_of_forecasts_is_made_once(spark, sf_dir):
    """What the forecast reads is kept, so no later pass goes back to the lines."""
    assert "lineitem" not in catalog.QUERIES["l09_ridge_forecast"](spark, sf_dir)._jdf.queryExecution().toString()


def test_letters_of_long_and_odd_sequences(spark):
    from tidemark.functions import sequence as Q

    given = {"": [], "AU": [], "AUGU": ["M"], "UAAAUG": [], "AUGéUGUGA": ["M", None], "AUG\nUGUUUUAGUUU": ["M", None, "F"], "AUG" * 200_000 + "UGA" + "UUU": ["M"] * 200_000, "AUG" * 200_000: ["M"] * 200_000, "AUAAUG": ["I", "M"]}
    df = spark.createDataFrame(list(enumerate(given)), "i int, rna string").select("i", Q.letters(F.col("rna")).alias("l"))
    assert [r["l"] for r in df.orderBy("i").collect()] == list(given.values())


def test_letters_are_found_once(spark, sf_dir):
    plan = catalog.QUERIES["a31_encoding_count"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1 and plan.count("[^ACGT]") == 1
