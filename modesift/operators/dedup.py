"""Near-duplicates among good modes: frequency clusters, then greedy types by score.

Clusters are marked on (omega, key) alone; only members of clusters with two or more have their shapes
taken and meet in Python. They are settled in rounds: of each cluster the ``BLOCK`` best open modes form
types among themselves, the new representatives are compared with all other open modes of the cluster in
slices of ``SLICE``, and those that match are settled too. A mode is settled only when all better ones
are, so the types are those of the sequential order, and no task holds more than a block and a slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..sources.tables import RunTables
from .relational import frequency_clusters

BLOCK, SLICE = 2048, 4096
SHAPE = "profile array<double>, r0 double, width double"


def shapes(mode: pd.Series) -> pd.DataFrame:
    """Ridge profile, centroid and width of modes: all of a mode that the comparison needs."""
    rows = []
    for m in mode:
        cells = np.array([list(row) for row in m], dtype=np.float32)
        profile = P.ridge_profile(cells, P.ridge(cells))
        rows.append((np.asarray(profile, dtype=np.float64), *map(float, P.profile_location(profile))))
    return pd.DataFrame(rows, columns=["profile", "r0", "width"])


def _members(df: DataFrame, group: list[str], key: str, tolerance: float, tables: RunTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of one; the list of clusters with a number ``cid`` and their sizes; and the members of larger
    ones with their shapes, which are taken after all others have gone."""
    marks = tables.stage("marks", lambda: frequency_clusters(df, group, "omega", key, tolerance, tables=tables))
    names = [*group, "cluster_index"]
    sizes = tables.stage("sizes", lambda: marks.groupBy(*names).agg(F.count("*").alias("members")).withColumn("cid", F.monotonically_increasing_id()))
    sized = marks.join(sizes.select(*(F.col(c).alias(f"size__{c}") for c in names), "members", "cid"), [F.col(c).eqNullSafe(F.col(f"size__{c}")) for c in names])
    alone = sized.where("members = 1").select(*group, key, "cluster_index", F.lit(1).alias("type_index"), F.lit(True).alias("selected"))
    kept = sized.where("members > 1").select(*(F.col(c).alias(f"mark__{c}") for c in [*group, key]), "cid", "members")
    both = kept.join(df.select(*group, key, "omega", "score", "mode"), [F.col(f"mark__{c}").eqNullSafe(F.col(c)) for c in [*group, key]])
    shaped = both.select("cid", "members", key, "omega", "score", F.pandas_udf(shapes, SHAPE)("mode").alias("shape")).select("cid", "members", key, "omega", "score", "shape.*")
    return alone, sizes, tables.stage("members", lambda: shaped)


def _by_score(key: str) -> list:
    """Best first; ties by frequency, then key; what is missing or not a number last."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    return [F.desc_nulls_last(number("score")), F.asc_nulls_last(number("omega")), F.asc(key)]


def same_types(a: pd.DataFrame, b: pd.DataFrame, tolerance: float, cosine: float, r_tol: float, width_tol: float) -> np.ndarray:
    """Whether each mode of a is of the type that each mode of b represents."""
    wa, wb = (f["omega"].to_numpy(dtype=float) for f in (a, b))
    out = np.abs(wa[:, None] - wb[None, :]) / np.maximum(np.abs(wb), 1e-12)[None, :] < tolerance
    out &= np.abs(a["r0"].to_numpy()[:, None] - b["r0"].to_numpy()[None, :]) < r_tol
    out &= np.abs(a["width"].to_numpy()[:, None] - b["width"].to_numpy()[None, :]) < width_tol
    la, lb = a["profile"].map(len).to_numpy(), b["profile"].map(len).to_numpy()
    for n in np.unique(la):
        mine = np.flatnonzero(la == n)
        x = np.stack(a["profile"].to_numpy()[mine]).astype(float)
        for m in np.unique(lb):
            theirs = np.flatnonzero(lb == m)
            y = np.stack(b["profile"].to_numpy()[theirs]).astype(float)
            if m != n:
                y = np.stack([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, m), row) for row in y]).astype(np.float32).astype(float)
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                c = np.abs(x @ y.T) / (nx[:, None] * ny[None, :])
            c = np.where(np.minimum(nx[:, None], ny[None, :]) < 1e-14, 0.0, c)
            near = c >= cosine
            for i, j in np.argwhere(np.abs(c - cosine) < 1e-9).tolist():  # a product of matrices may round otherwise than one of vectors
                near[i, j] = P.same_type((x[i], 0.0, 0.0), (y[j], 0.0, 0.0), cosine)
            out[np.ix_(mine, theirs)] &= near
    return out


def _block_types(key: str, limits: tuple[float, float, float, float]):
    """Types among a block of a cluster, best first; representatives with their shapes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place").reset_index(drop=True)
        same = same_types(frame, frame, *limits)
        reps: list[int] = []
        at = np.zeros(len(frame), dtype=np.int32)
        for i in range(len(frame)):
            hit = np.flatnonzero(same[i, reps]) if reps else []
            if len(hit):
                at[i] = hit[0] + 1
            else:
                reps.append(i)
                at[i] = len(reps)
        chosen = np.zeros(len(frame), dtype=bool)
        chosen[reps] = True
        out = frame[["cid", "members", key, "omega", "r0", "width"]].assign(type=at, selected=chosen)
        out["profile"] = frame["profile"].where(chosen, None)
        return out

    return run


def _first_type(key: str, limits: tuple[float, float, float, float]):
    """The first representative's type that each mode of a slice is of, 0 for none."""

    def run(modes: pd.DataFrame, reps: pd.DataFrame) -> pd.DataFrame:
        at = np.zeros(len(modes), dtype=np.int32)
        if len(modes) and len(reps):
            reps = reps.sort_values("type")
            same = same_types(modes, reps, *limits)
            at = np.where(same.any(axis=1), reps["type"].to_numpy()[same.argmax(axis=1)], 0)
        return modes[["cid", key]].assign(type=at.astype(np.int32))

    return run


def _typed(frame: pd.DataFrame, key: str, tolerance: float, cosine: float, r_tol: float, width_tol: float) -> tuple[pd.DataFrame, list[tuple]]:
    """type_index and selected of a cluster's members, and the comparisons made."""
    frame = frame.sort_values(["score", "omega", key], ascending=[False, True, True], kind="stable")
    kept = [(np.asarray(p, dtype=np.float64), r0, width) for p, r0, width in zip(frame["profile"], frame["r0"], frame["width"], strict=True)]
    omega, names = frame["omega"].to_numpy(), frame[key].tolist()
    types: list[int] = []
    at, chosen, log = np.zeros(len(frame), dtype=int), np.zeros(len(frame), dtype=bool), []
    for i in range(len(frame)):
        for t, rep in enumerate(types):
            apart = abs(omega[i] - omega[rep]) / max(abs(omega[rep]), 1e-12)
            same = bool(apart < tolerance and P.same_type(kept[i], kept[rep], cosine, r_tol, width_tol))
            log.append((names[i], names[rep], float(apart), float(abs(kept[i][1] - kept[rep][1])), float(abs(kept[i][2] - kept[rep][2])), same))
            if same:
                at[i] = t + 1
                break
        else:
            types.append(i)
            at[i], chosen[i] = len(types), True
    return frame.assign(type_index=at, selected=chosen), log


def representatives(df: DataFrame, group: list[str], key: str = "mode_id", tolerance: float = 0.02, cosine: float = 0.90, r_tol: float = 0.10, width_tol: float = 0.05, block: int = BLOCK, slice_: int = SLICE, tables: RunTables | None = None) -> DataFrame:
    """df(group, key, omega, score, mode): group, key, cluster_index, type_index, selected.

    In a cluster modes are taken by score, best first (ties by frequency, then key), and join the first
    type whose representative is close in frequency, profile, centroid and width; else they open one and
    represent it. A cluster of one is its own representative. A cluster of n modes without any duplicates
    takes n / block rounds; copies go in the first that has their representative."""
    tables = tables or RunTables(df.sparkSession)
    alone, sizes, open_ = _members(df, group, key, tolerance, tables)
    limits = (tolerance, cosine, r_tol, width_tol)
    kind = df.schema[key].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy("cid").orderBy(*_by_score(key)))
    large = not sizes.where(F.col("members") > block).isEmpty()
    settled, counts, r = [], [], 0
    while True:
        best = open_.withColumn("place", place).where(F.col("place") <= block)
        typed = tables.stage(f"types{r}", lambda best=best: best.groupBy("cid").applyInPandas(_block_types(key, limits), f"cid long, members long, `{key}` {kind}, omega double, r0 double, width double, type int, selected boolean, profile array<double>"))
        settled.append(typed.select("cid", key, "type", "selected", F.lit(r).alias("round")))
        if not large:
            break
        counts.append(typed.where("selected").groupBy("cid").agg(F.count("*").cast("int").alias("reps")).withColumn("round", F.lit(r)))
        slices = F.ceil(F.col("members") / F.lit(float(slice_))).cast("int")
        rest = open_.where(F.col("members") > block).join(typed.select("cid", key), ["cid", key], "left_anti").withColumn("slice", F.pmod(F.xxhash64(key), slices).cast("int"))
        reps = typed.where(F.col("selected") & (F.col("members") > block)).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        met = tables.stage(f"met{r}", lambda rest=rest, reps=reps: rest.groupBy("cid", "slice").cogroup(reps.groupBy("cid", "slice")).applyInPandas(_first_type(key, limits), f"cid long, `{key}` {kind}, type int"))
        settled.append(met.where("type > 0").select("cid", key, "type", F.lit(False).alias("selected"), F.lit(r).alias("round")))
        now = tables.stage(f"open{r}", lambda now=open_, met=met: now.join(met.where("type = 0"), ["cid", key], "left_semi"))
        if now.isEmpty():
            break
        open_, r = now, r + 1
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    if counts:  # types of later rounds are numbered on from those before
        each = counts[0]
        for more in counts[1:]:
            each = each.unionByName(more)
        before = F.coalesce(F.sum("reps").over(Window.partitionBy("cid").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.join(each.withColumn("before", before.cast("int")), ["cid", "round"]).withColumn("type", F.col("type") + F.col("before"))
    named = found.join(sizes, "cid").select(*group, key, "cluster_index", F.col("type").alias("type_index"), "selected")
    return alone.unionByName(named)


def comparisons(df: DataFrame, group: list[str], key: str = "mode_id", tolerance: float = 0.02, cosine: float = 0.90, r_tol: float = 0.10, width_tol: float = 0.05, tables: RunTables | None = None) -> DataFrame:
    """What the sequential order compares: group, cluster_index, the mode, the representative it is held
    against, how far they are apart in frequency (relative), centroid and width, and whether they are one
    type. A log to look into clusters with, made a cluster a task."""
    tables = tables or RunTables(df.sparkSession)
    _, sizes, members = _members(df, group, key, tolerance, tables)
    kind = df.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        log = _typed(frame, key, tolerance, cosine, r_tol, width_tol)[1]
        return pd.DataFrame(log, columns=[key, "against", "relative_omega", "d_r0", "d_width", "same"]).assign(cid=frame["cid"].iloc[0])

    log = members.groupBy("cid").applyInPandas(run, f"cid long, `{key}` {kind}, against {kind}, relative_omega double, d_r0 double, d_width double, same boolean")
    return log.join(sizes, "cid").select(*group, "cluster_index", key, "against", "relative_omega", "d_r0", "d_width", "same")
