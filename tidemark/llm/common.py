"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage where no contract says otherwise.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, one of our own, but only if there is one machine."""
    named, current = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if named is None and current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept reliably in the shared folder, so that no lost executor makes it be computed again."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


class Table:
    """A written table in the shared folder: Parquet, so it takes less room than a checkpoint and readers take the columns they need. With ``by``, it is
    dealt by that column's hash into as many buckets as shuffles have partitions, so that joins and aggregations by it read it without a shuffle.
    """

    def __init__(self, df: DataFrame, by: str | None = None):
        self.spark, self.by = df.sparkSession, by
        self.name = f"tidemark_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_root(self.spark).rstrip('/')}/{self.name}"
        if by is None:
            df.write.parquet(self.path)
        else:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.format("parquet").option("path", self.path).bucketBy(parts, by).sortBy(by).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path) if self.by is None else self.spark.table(self.name)

    def drop(self) -> None:
        """Nothing reads the table any more: its entry and its files go."""
        if self.by is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so that extra columns of the input can't clash with ours."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of at most ``size``, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of phases that are over (it does so when the driver's garbage is collected)."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
