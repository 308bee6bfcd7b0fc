"""Types of near-duplicates in rounds of blocks and slices against the sequential order."""

import numpy as np
import pandas as pd
import pytest

from modesift.operators import dedup
from modesift.operators import relational as R

LIMITS = (0.02, 0.90, 0.10, 0.05)


def modes(seed, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        nr = int(rng.choice([16, 21]))
        r = np.linspace(0, 1, nr)
        at = rng.choice([0.2, 0.3, 0.5, 0.55, 0.8]) + rng.normal() * 0.01
        mode = np.stack([(h + 1) * np.exp(-(((r - at) / 0.15) ** 2)) for h in range(4)]) + rng.normal(size=(4, nr)) * 0.1
        if i % 29 == 0:
            mode[:] = 0
        score = None if i % 31 == 0 else float("nan") if i % 37 == 0 else float(rng.integers(5)) / 4
        rows.append((None if i % 5 == 0 else int(i % 3), f"m{i:03d}", float(1 + rng.uniform(0, 0.06)), score, mode.tolist()))
    return rows


def loop(rows):
    """group, key -> (type_index, selected) by the sequential order, a cluster at a time."""
    out = {}
    frame = pd.DataFrame(rows, columns=["group", "mode_id", "omega", "score", "mode"])
    frame["group"] = frame["group"].fillna(-1)
    for _, own in frame.groupby("group"):
        own = own.sort_values(["omega", "mode_id"])
        index, anchor, at = 0, None, []
        for v in own["omega"]:
            if anchor is None or abs(v - anchor) / abs(anchor) >= 0.02:
                index, anchor = index + 1, v
            at.append(index)
        for _, cluster in own.groupby(np.array(at)):
            shaped = cluster.reset_index(drop=True).join(dedup.shapes(cluster["mode"]))
            typed, _ = dedup._typed(shaped, "mode_id", *LIMITS)
            out |= {k: (int(t), bool(s)) for k, t, s in zip(typed["mode_id"], typed["type_index"], typed["selected"], strict=True)}
    return out


@pytest.mark.parametrize("seed,block,slice_", [(1, 2048, 4096), (2, 4, 3), (3, 1, 2)])
def test_rounds_equal_the_sequential_order(spark, seed, block, slice_):
    rows = modes(seed)
    df = spark.createDataFrame(rows, "ntor int, mode_id string, omega double, score double, mode array<array<double>>").repartition(3)
    got = dedup.representatives(df, ["ntor"], block=block, slice_=slice_).collect()
    assert len(got) == len(rows)
    assert {r.mode_id: (r.type_index, r.selected) for r in got} == loop(rows)


def test_shapes_are_taken_of_members_only(spark, monkeypatch):
    rows = [(1, "a", 1.0, 0.5, [[1.0, 2.0], [0.0, 1.0]]), (1, "b", 1.001, 0.4, [[1.0, 2.0], [0.0, 1.0]]), (1, "alone", 5.0, 0.5, None)]
    df = spark.createDataFrame(rows, "ntor int, mode_id string, omega double, score double, mode array<array<double>>")
    got = {r.mode_id: (r.cluster_index, r.type_index, r.selected) for r in dedup.representatives(df, ["ntor"]).collect()}
    assert got == {"a": (1, 1, True), "b": (1, 1, False), "alone": (2, 1, True)}  # a mode that could have no shape is not asked for one


def test_empty(spark):
    df = spark.createDataFrame([], "ntor int, mode_id string, omega double, score double, mode array<array<double>>")
    assert dedup.representatives(df, ["ntor"]).count() == 0 and R.frequency_clusters(df, ["ntor"], "omega", "mode_id").count() == 0
