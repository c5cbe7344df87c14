"""SparkSession factory with the settings every tidemark query assumes (UTC, AQE, Arrow)."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted session is used as it is."""
    n = cores or os.environ.get("TIDEMARK_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context, so that their Python finds it wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_shipped", False):
        here = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark", "zip", here.parent, here.name)
        context.addPyFile(made)  # the driver serves it
        context._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``; a temporary one only if there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/tidemark_{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """A folder and all in it, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder that all executors see, removed at the end, also on errors."""
    path = shared_folder(spark)
    try:
        yield path
    finally:
        remove_folder(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept reliably in the shared folder: lost executors don't have it computed again, in another order. Spark deletes it with
    its last reader if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``get_session`` does.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
