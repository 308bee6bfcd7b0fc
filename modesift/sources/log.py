"""An append-only log of rows: numbered commits, replays without doubles, compaction.

A batch is written as Parquet by the executors and then committed by one small numbered file that names
its parts; what no commit names is not part of the log. A batch has a name, and a name is committed once:
one that comes again, after a crash or a retried micro-batch, changes nothing. Compaction writes all rows
as one part and commits it in place of all commits before; readers see the log before it or after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AppendLog:
    """The log below ``root``. Rows get ``log_seq`` (their commit) and ``log_pos`` (their place in it), which order them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[tuple[int, dict]]:
        """Commits from the last compaction on, in order."""
        fs, folder = self._path("commits")
        if not fs.exists(folder):
            return []
        numbers = sorted((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)), reverse=True)
        out = []
        for n in numbers:
            stream = fs.open(self._path(f"commits/{n:012d}.json")[1])
            try:
                told = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            out.append((n, told))
            if told["compacted"]:
                break
        return out[::-1]

    def _commit(self, number: int, told: dict) -> bool:
        """Whether the number was still free."""
        fs, path = self._path(f"commits/{number:012d}.json")
        try:
            out = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(told, sort_keys=True).encode()))
        finally:
            out.close()
        return True

    def append(self, df: DataFrame, batch: str) -> bool:
        """Adds the rows of df as the batch of that name; False, and nothing added, if it is there already."""
        if self.has(batch):
            return False
        part = f"data/{uuid.uuid4().hex}"
        df.withColumn("log_pos", F.monotonically_increasing_id()).write.parquet(f"{self.root}/{part}")
        while True:
            commits = self._commits()
            if any(batch in told["batches"] for _, told in commits):
                fs, path = self._path(part)  # another writer was first with the same batch
                fs.delete(path, True)
                return False
            number = commits[-1][0] + 1 if commits else 1
            if self._commit(number, {"parts": [[number, part]], "batches": [batch], "schema": json.loads(df.schema.json()), "compacted": False}):
                return True

    def has(self, batch: str) -> bool:
        return any(batch in told["batches"] for _, told in self._commits())

    def read(self) -> DataFrame | None:
        """All rows of the log; None before the first commit. Columns that later batches add are NULL before."""
        out = None
        for number, told in self._commits():
            schema = T.StructType.fromJson(told["schema"]).add("log_pos", "long")
            if told["compacted"]:
                schema = schema.add("log_seq", "long")
            for _, part in told["parts"]:
                rows = self.spark.read.schema(schema).parquet(f"{self.root}/{part}")
                rows = rows if told["compacted"] else rows.withColumn("log_seq", F.lit(number).cast("long"))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def latest(self, key: str) -> DataFrame | None:
        """The last row of each key."""
        rows = self.read()
        if rows is None:
            return None
        whole = F.struct(*(c for c in rows.columns if c != key))
        return rows.groupBy(key).agg(F.max_by(whole, F.struct("log_seq", "log_pos")).alias("x")).select(key, "x.*")

    def compact(self) -> None:
        """All commits so far as one; names of batches are kept, so that these still count as done."""
        commits = self._commits()
        if len(commits) < 2:
            return
        rows = self.read()
        part = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{part}")
        told = {"parts": [[commits[-1][0] + 1, part]], "batches": sorted({b for _, t in commits for b in t["batches"]}), "schema": json.loads(rows.drop("log_pos", "log_seq").schema.json()), "compacted": True}
        if not self._commit(commits[-1][0] + 1, told):
            fs, path = self._path(part)
            fs.delete(path, True)
            raise RuntimeError("the log has grown meanwhile; compact it again")
