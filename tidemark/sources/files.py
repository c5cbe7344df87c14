"""Sources and sinks: Parquet, CSV, JSON, arrays."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as strings, empty for missing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path).na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_report(report: dict, path: str) -> str:
    """A small report, keys in order, on the driver; the text that was written."""
    text = json.dumps(report, indent=2, sort_keys=True, default=str)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def read_json_report(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def array_bundle(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): each series as one array, in order; groups are single series."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def codon_lines(df: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines of four fields: codon, abbreviation, letter, name, which is the rest of the line; and the columns to keep. Lines of fewer fields go."""
    parts = F.split(F.trim(column), r"\s+", 4)
    return df.filter(F.size(parts) == 4).select(*keep, *(parts[i].alias(n) for i, n in enumerate(("codon", "abbr", "letter", "name"))))
