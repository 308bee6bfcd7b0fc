"""Stage tables of a run: written once, read back with their schema, taken up again after a failure.

A run is a row of named stages. Each is one Parquet table below the run's folder, made by the executors;
beside its parts a small manifest says which schema and settings it was made with. The manifest is put
in place by one rename after the parts are committed, so a table with a manifest is whole, and a table
without one is made again. What follows a stage reads the table: plans stay as small as one stage, no
lineage is repeated, and a run that was killed goes on after its last whole stage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST = "_stage.json"  # Parquet readers pass over names that begin so


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: spark.checkpoint.dir, or else a folder in the warehouse."""
    own = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/modesift-runs"
    return own.rstrip("/")


class RunTables:
    """The tables of one run. ``root``: a folder that all share; a run given the same one again continues.
    Without it the run has a folder of its own. ``settings`` says what the tables depend on besides their
    input: a whole table that was made with other settings is an error, not a result."""

    def __init__(self, spark: SparkSession, root: str | None = None, settings: str = ""):
        self.spark, self.settings = spark, settings
        self.root = (root or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}").rstrip("/")
        self.made: list[str] = []

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifest(self, name: str) -> dict | None:
        fs, path = self._path(f"{name}/{MANIFEST}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)  # not by spark.read, which passes over such names too
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name; ``build`` is called only where it is not there yet."""
        told = self._manifest(name)
        if told is None:
            df = build()
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
            told = {"schema": json.loads(df.schema.json()), "settings": self.settings}
            fs, part = self._path(f"{name}/{MANIFEST}.part")
            out = fs.create(part, True)
            try:
                out.write(bytearray(json.dumps(told, sort_keys=True).encode()))
            finally:
                out.close()
            if not fs.rename(part, self._path(f"{name}/{MANIFEST}")[1]):
                raise OSError(f"the manifest of {self.root}/{name} can't be put in place")
            self.made.append(name)
        return self._table(name, told)

    def has(self, name: str) -> bool:
        """Whether the table is there as a whole."""
        fs, path = self._path(f"{name}/{MANIFEST}")
        return fs.exists(path)

    def read(self, name: str) -> DataFrame:
        """A table that is there; KeyError if it is not."""
        told = self._manifest(name)
        if told is None:
            raise KeyError(name)
        return self._table(name, told)

    def _table(self, name: str, told: dict) -> DataFrame:
        if told["settings"] != self.settings:
            raise ValueError(f"{self.root}/{name} was made with other settings: {told['settings']!r}, not {self.settings!r}")
        return self.spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names the whole run."""
        for name in names or ("",):
            fs, path = self._path(name) if name else self._path(".")
            fs.delete(path, True)
