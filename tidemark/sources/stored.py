"""A stored table whose parts are replaced as a whole: data are written aside first, and a manifest is switched last, so a failed run leaves what was there.

A table is a folder. ``data`` has Parquet files by part and run; ``commits`` has a manifest for each commit, which says of which run each part is. Readers take the last manifest and read only the folders that it
names, so files of a run that failed, or was replaced, are not seen. A commit is the renaming of a small file to a name that must be new: of two writers that began with the same manifest, the second one fails and can begin again.
What a manifest holds is an entry a part, as Spark's own listing of a partitioned table does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import relational as R

RUN = "run_"  # the innermost folder of a part


class Conflict(RuntimeError):
    """Another writer has committed since the manifest was read."""


class Stored:
    def __init__(self, spark: SparkSession, path: str, parts: Sequence[str]):
        if not parts:
            raise ValueError("a stored table has parts")
        self.spark, self.path, self.parts = spark, path.rstrip("/"), list(parts)
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def _commits(self) -> list[int]:
        folder = self._at(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """{number, runs: run by part, schema}; an empty one before the first commit."""
        numbers = self._commits()
        if not numbers:
            return {"number": 0, "runs": {}, "schema": None, "done": []}
        number = number or numbers[-1]
        stream = self._fs.open(self._at(f"{self.path}/commits/{number:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()) | {"number": number}
        finally:
            stream.close()

    def _commit(self, before: dict, runs: dict, schema: str, run: str) -> int:
        number = before["number"] + 1
        body = json.dumps({"runs": dict(sorted(runs.items())), "schema": json.loads(schema), "done": sorted({*before["done"], run})}, sort_keys=True)
        aside, final = self._at(f"{self.path}/commits/_{uuid.uuid4().hex}"), self._at(f"{self.path}/commits/{number:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(body.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(aside, final, options)
        except Exception as e:  # the name is taken
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"commit {number} of {self.path} is another writer's") from None
            raise
        return number

    # Data

    def _folders(self, run: str) -> list[str]:
        """The parts that a run has written."""
        found = self._fs.globStatus(self._at(f"{self.path}/data/{'/'.join('*' for _ in self.parts)}/{RUN}={run}"))
        root = self._fs.makeQualified(self._at(f"{self.path}/data")).toUri().getPath()
        return sorted(s.getPath().getParent().toUri().getPath()[len(root) + 1 :] for s in found or [])

    def _drop(self, run: str, parts: Sequence[str]) -> None:
        for part in parts:
            self._fs.delete(self._at(f"{self.path}/data/{part}/{RUN}={run}"), True)

    def read(self, number: int | None = None, only: Sequence[str] | None = None) -> DataFrame | None:
        """The table as of a commit, the last one if none is named; ``only`` these parts of it. None before the first commit."""
        m = self.manifest(number)
        if m["schema"] is None:
            return None
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{part}/{RUN}={run}" for part, run in m["runs"].items() if only is None or part in set(only)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*(f for f in schema if f.name not in self.parts), *(schema[p] for p in self.parts), T.StructField(RUN, T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def replace_parts(self, df: DataFrame, run: str | None = None, all_parts: bool = False, emptied: Sequence[str] = (), since: dict | None = None) -> int:
        """The parts that ``df`` has rows of become these rows; other parts stay, unless all are to be replaced, and ``emptied`` ones go. The number of the commit.

        With the name of a ``run``, a rerun of one that failed writes anew, and one of a run that is committed does nothing. ``since``: the manifest that ``df`` was made from, if it was.
        """
        before, run = since or self.manifest(), run or uuid.uuid4().hex
        if run in before["done"]:
            return before["number"]
        self._drop(run, self._folders(run))  # what a failed run has left
        df.withColumn(RUN, F.lit(run)).repartition(*self.parts).write.mode("append").partitionBy(*self.parts, RUN).parquet(f"{self.path}/data")
        new = self._folders(run)
        kept = {} if all_parts else {p: r for p, r in before["runs"].items() if p not in set(emptied)}
        try:
            return self._commit(before, kept | dict.fromkeys(new, run), df.schema.json(), run)
        except Conflict:
            self._drop(run, new)
            raise

    def upsert(self, new: DataFrame, keys: Sequence[str], order: Sequence[str], run: str | None = None) -> int:
        """The last row of each key, old or new, by ``order``; parts must be functions of the keys. Only the parts that ``new`` has rows of are read and written."""
        m = self.manifest()
        if run and run in m["done"]:
            return m["number"]
        touched = {self._named(r) for r in new.select(*self.parts).distinct().collect()} & set(m["runs"])  # an entry a part
        old = self.read(m["number"], sorted(touched)) if touched else None
        merged = R.last_per_key(new, list(keys), list(order)) if old is None else R.upsert(old, new, list(keys), list(order))
        return self.replace_parts(merged, run, since=m)

    def _named(self, row) -> str:
        """A part's folder, as Spark names it."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{escape(c)}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None or row[c] == '' else escape(str(row[c]))}" for c in self.parts)

    def vacuum(self, keep: int = 1) -> int:
        """Removes what none of the last ``keep`` manifests names, files of failed runs too; the number of folders removed. Not beside a running writer."""
        numbers = self._commits()[-keep:]
        named = {(p, r) for n in numbers for p, r in self.manifest(n)["runs"].items()}
        gone = 0
        root = self._fs.makeQualified(self._at(f"{self.path}/data")).toUri().getPath()
        for s in self._fs.globStatus(self._at(f"{self.path}/data/{'/'.join('*' for _ in self.parts)}/{RUN}=*")) or []:
            part, run = s.getPath().getParent().toUri().getPath()[len(root) + 1 :], s.getPath().getName().removeprefix(f"{RUN}=")
            if (part, run) not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        for n in self._commits()[: -len(numbers) or None]:
            self._fs.delete(self._at(f"{self.path}/commits/{n:012d}.json"), False)
        return gone
