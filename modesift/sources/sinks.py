"""Writers: fixed CSV schemas, stable JSON, vertical summaries and routed fan-out.

Reports of a run are small (a row a mode or less) and of fixed names, so they are written by the driver
from a row iterator, atomically. Tables that grow are written as Parquet by the executors instead.
"""

from __future__ import annotations

import csv
import json
import math
import os
import tempfile
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_json(value: Any) -> str:
    """Sorted keys, no spaces, null for what is not finite."""

    def plain(v: Any) -> Any:
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if hasattr(v, "asDict"):
            v = v.asDict()
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def text(value: Any) -> str:
    """A CSV cell: empty for null and non-finite, JSON for nested values."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return ""
    return stable_json(value) if isinstance(value, (dict, list, tuple)) or hasattr(value, "asDict") else str(value)


def write_text(path: str, content: str) -> None:
    """Whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "w", newline="") as f:
            f.write(content)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_rows(path: str, columns: list[str], rows: Iterable[Any]) -> int:
    """Rows as CSV with a header, even without any; returns how many."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    n = 0
    with os.fdopen(fd, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(columns)
        for row in rows:
            out.writerow([text(row[c]) for c in columns])
            n += 1
    os.replace(part, path)
    return n


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Sorted, missing values last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in order))


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> int:
    """A DataFrame as one ordered CSV, a partition at a time on the driver."""
    return write_rows(path, columns, _ordered(df, order).select(*columns).toLocalIterator())


def write_vertical(values: dict[str, Any], path: str) -> None:
    write_rows(path, ["field", "value"], [{"field": k, "value": v} for k, v in values.items()])


def fan_out(df: DataFrame, root: str, routes: dict[str, Column], columns: list[str], order: list[str], by_executors: bool = False) -> dict[str, int]:
    """One CSV a route from one sorted and persisted input; a filter keeps its order, so a run is sorted
    once. Returns the row counts. by_executors: every route is a folder of sorted parts that executors write
    to a store all share, nested values as JSON; else one file a route that the driver writes."""
    kept = _ordered(df, order).select(*columns, *(c.alias(f"route__{name}") for name, c in routes.items())).persist()
    try:
        if not by_executors:
            return {name: write_rows(f"{root}/{name}.csv", columns, kept.where(f"`route__{name}`").select(*columns).toLocalIterator()) for name in routes}
        nested = {f.name for f in kept.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
        flat = [F.to_json(c).alias(c) if c in nested else F.col(c) for c in columns]
        for name in routes:
            kept.where(f"`route__{name}`").select(*flat).write.mode("overwrite").csv(f"{root}/{name}", header=True)
        counts = kept.agg(*(F.count_if(f"route__{name}").alias(name) for name in routes)).first()
        return {name: counts[name] for name in routes}
    finally:
        kept.unpersist()


def move_plan(df: DataFrame, decision: str = "final_label", bad: str = "bad") -> DataFrame:
    """Where rejected files would go; nothing is moved."""
    return df.where(f"{decision} = '{bad}'").selectExpr("path AS source", "regexp_replace(path, '/([^/]+)$', '/out/$1') AS target")
