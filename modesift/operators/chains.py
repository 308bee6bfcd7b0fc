"""Greedy chains over sorted values of a group too large for one task.

A cluster starts at an anchor and takes the values near it; the first value beyond is the next anchor. A
chain of anchors is sequential, but what a range of values does to it depends only on where the chain
enters. So rows are dealt to ranges (by group, value and key), each range states for every place where a
chain can enter by which bound it leaves and how many anchors it had (pointer doubling in the range),
ranges are joined to hops of 1, 2, 4 ... ranges (pointer doubling over their borders), and the hops are
followed from each group's first row. Only the followed path, at most one entry a range, is known to the
driver; rows get their clusters range by range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import RunTables

PART = 1_000_000


def joins(v, anchor, tolerance: float):
    """Whether a value at or above its anchor is near it."""
    return np.abs(v - anchor) / np.maximum(np.abs(anchor), 1e-12) < tolerance


def bounds(a: np.ndarray, tolerance: float) -> np.ndarray:
    """The least value that doesn't join each anchor, to the last bit; infinite anchors are joined by none."""
    out = np.full(len(a), -np.inf)
    at = np.flatnonzero(np.isfinite(a))
    with np.errstate(over="ignore", invalid="ignore"):
        v = a[at]
        x = v + tolerance * np.maximum(np.abs(v), 1e-12)
        while (low := joins(x, v, tolerance)).any():
            x = np.where(low, np.nextafter(x, np.inf), x)
        while (high := (x > v) & ~joins(np.nextafter(x, -np.inf), v, tolerance)).any():
            x = np.where(high, np.nextafter(x, -np.inf), x)
    out[at] = x
    return out


def _places(value: pd.Series, single: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values to search in (what joins nothing stands at either end) and which rows are clusters of their own."""
    return value.to_numpy(dtype=float), single.to_numpy(dtype=bool)


def _next(s: np.ndarray, single: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The next anchor's place after each row as an anchor, in this range (its length: beyond), and the bound left by."""
    b = np.where(single, -np.inf, bounds(s, tolerance))
    return np.where(single, np.arange(len(s)) + 1, np.maximum(np.searchsorted(s, b), np.arange(len(s)) + 1)), b


_HOPS = "gid long, part int, s double, b double, n long"


def _range_function(tolerance: float):
    """Of each place where a chain can enter a range: the bound it leaves by, and its anchors in the range."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["kind", "s", "row"], kind="stable")
        s, single = _places(frame["s"], frame["single"])
        to, b = _next(s, single, tolerance)
        n = len(s)
        last, count = np.arange(n), np.ones(n, dtype=np.int64)
        while (more := to < n).any():
            at = to[more]
            count[more] += count[at]
            last[more] = last[at]
            to[more] = to[at]
        stop = 1 if single[0] else int(np.searchsorted(s, b[0])) + 1
        enter = np.flatnonzero(np.append(True, s[1:stop] != s[: stop - 1][: len(s[1:stop])]))
        return pd.DataFrame({"gid": frame["gid"].iloc[0], "part": frame["part"].iloc[0], "s": s[enter], "b": b[last[enter]], "n": count[enter]})

    return run


def _composer():
    """Hops that end in a range, followed by that range's own hops."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("s")
        at = np.searchsorted(right["s"].to_numpy(), left["b"].to_numpy())
        then = right.iloc[at]
        return pd.DataFrame({"gid": left["gid"], "part": left["part"], "s": left["s"], "b": then["b"].to_numpy(), "n": left["n"] + then["n"].to_numpy(), "to": then["to"].to_numpy()})

    return run


def _assigner(entries: dict[tuple[int, int], tuple[float, int]], names: list[str], tolerance: float):
    """cluster_index of a range's rows, given the bound by which the chain enters and the clusters before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["kind", "s", "row"], kind="stable")
        s, single = _places(frame["s"], frame["single"])
        b, before = entries[int(frame["gid"].iloc[0]), int(frame["part"].iloc[0])]
        to, _ = _next(s, single, tolerance)
        start = np.zeros(len(s), dtype=np.int64)
        i = int(np.searchsorted(s, b))
        while i < len(s):
            start[i] = 1
            i = int(to[i])
        return frame.assign(cluster_index=(before + np.cumsum(start)).astype(np.int32))[[*names, "cluster_index"]]

    return run


def chain_clusters(df: DataFrame, group: list[str], value: str, key: str, tolerance: float, tables: RunTables, name: str = "chain", part: int = PART) -> DataFrame:
    """df(group, key, value) with cluster_index, for groups of any size; ``part`` rows make a range."""
    v = F.col(value).cast("double")
    kind = F.when(v.isNull(), 0).when(F.isnan(v), 2).otherwise(1)
    s = F.when(v.isNull(), F.lit(float("-inf"))).when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
    single = (kind != 1) | (F.abs(s) == float("inf"))
    ids = tables.stage(f"{name}_groups", lambda: df.groupBy(*group).agg(F.count("*").alias("chain__n")).withColumn("gid", F.monotonically_increasing_id()))
    total = ids.agg(F.sum("chain__n")).first()[0] or 0
    ranges = max(1, -(-total // part))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in group]

    def dealt() -> DataFrame:
        rows = df.select(*group, key, value)
        rows = rows.join(ids, same(rows, ids)).select("gid", *(rows[c] for c in group), rows[key], rows[value], kind.alias("kind"), s.alias("s"), single.alias("single"))
        rows = rows.repartitionByRange(ranges, "gid", "kind", "s", key).sortWithinPartitions("gid", "kind", "s", key)
        return rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})

    rows = tables.stage(f"{name}_ranges", dealt)
    # At most one row a range and a group's border: this table and the path below are all that the driver holds.
    heads = rows.groupBy("gid", "part").agg(F.min("s").alias("first"), F.max("s").alias("last")).toArrow().to_pandas().sort_values(["gid", "part"])
    parts = {g: (own["part"].to_numpy(), own["last"].to_numpy()) for g, own in heads.groupby("gid")}
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def targets(frames):
        """The range of each hop's end: the next that reaches up to the bound; -1 at the group's end."""
        for f in frames:
            to = np.full(len(f), -1, dtype=np.int64)
            for g, own in f.groupby("gid").indices.items():
                numbers, last = shared.value[g]
                at = np.maximum(np.searchsorted(numbers, f["part"].to_numpy()[own], side="right"), np.searchsorted(last, f["b"].to_numpy()[own]))
                to[own] = np.where(at < len(numbers), numbers[np.minimum(at, len(numbers) - 1)], -1)
            yield f.assign(to=to.astype(np.int32))

    hops = [tables.stage(f"{name}_hops0", lambda: rows.groupBy("gid", "part").applyInPandas(_range_function(tolerance), _HOPS).mapInPandas(targets, f"{_HOPS}, to int"))]
    while 1 << len(hops) < max((len(p) for p, _ in parts.values()), default=1):
        now = hops[-1]
        ends = now.where("to >= 0").withColumn("at", F.col("to")).groupBy("gid", "at")
        then = now.withColumn("at", F.col("part")).groupBy("gid", "at")
        further = ends.cogroup(then).applyInPandas(_composer(), f"{_HOPS}, to int")
        hops.append(tables.stage(f"{name}_hops{len(hops)}", lambda further=further, now=now: further.unionByName(now.where("to < 0"))))

    path = {(g, int(p[0])): (float("-inf"), 0) for g, (p, _) in parts.items()}
    for k in reversed(range(len(hops))):
        found = _follow(hops[k], path)
        for r in found:
            if r.to >= 0:
                path[r.gid, r.to] = (r.b, path[r.gid, r.part][1] + r.n)
    begun = {(r.gid, r.part): r.n for r in _follow(hops[0], path)}
    entries: dict[tuple[int, int], tuple[float, int]] = {}
    for g, (numbers, _) in parts.items():
        clusters = 0
        for p in map(int, numbers):
            if (g, p) in path:
                entries[g, p] = path[g, p]
                clusters = path[g, p][1] + begun[g, p]
            else:  # no anchor in this range
                entries[g, p] = (float("inf"), clusters)
    names = [*group, key, value]
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return rows.groupBy("gid", "part").applyInPandas(_assigner(entries, names, tolerance), f"{schema}, cluster_index int")


def _follow(hops: DataFrame, path: dict) -> list:
    """The hop of each entry on the path: that of the first place in its range at or above the bound."""
    known = hops.sparkSession.createDataFrame([(g, p, b) for (g, p), (b, _) in path.items()], "gid long, part int, bound double")
    own = hops.join(F.broadcast(known), ["gid", "part"]).where("s >= bound")  # one row a range
    first: Column = F.min_by(F.struct("to", "b", "n"), "s")
    return own.groupBy("gid", "part").agg(first.alias("x")).select("gid", "part", "x.*").collect()
