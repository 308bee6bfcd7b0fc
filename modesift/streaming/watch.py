"""The batch transforms over arriving files: an extension, with the same results as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import scoring as S
from ..sources.log import AppendLog


def scores(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    """Score tables (Parquet) as they arrive, fused and flagged."""
    return S.flagged(S.fuse(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)))


def append(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """An append-only log; a restart goes on where the checkpoint ends, each file once."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, log: AppendLog, name: str, checkpoint: str):
    """Micro-batches into a log, each by its number: one that is run again after a crash adds nothing."""
    return each_batch(stream, lambda batch, number: log.append(batch, f"{name}-{number}"), checkpoint)
