"""Clusters of hot groups, dealt to ranges of values, against the scan of whole groups and the loop."""

import numpy as np
import pytest

from modesift.operators import chains
from modesift.operators import relational as R


@pytest.mark.parametrize("seed,hot", [(1, 40), (2, 700), (3, 3000)])
def test_ranges_equal_the_scan(spark, seed, hot):
    rng = np.random.default_rng(seed)
    odd = [0.0, -0.0, np.inf, -np.inf, np.inf, 1e308, 1.7e308, -1e308]
    vals = np.concatenate([rng.uniform(1, 1.5, 2000), rng.uniform(-3, 3, 600), np.full(300, 3.0), 10.0 ** rng.uniform(-20, 20, 500), rng.integers(100, 200, 600).astype(float), odd, np.full(5, np.nan)])
    rng.shuffle(vals)
    groups = rng.choice(4, size=len(vals), p=[0.1, 0.1, 0.75, 0.05])
    rows = [(int(g) if g else None, f"k{i:05d}", None if i % 37 == 0 else float(v)) for i, (g, v) in enumerate(zip(groups, vals, strict=True))]
    df = spark.createDataFrame(rows, "ntor int, mode_id string, omega double")
    found = lambda h: {r.mode_id: r.cluster_index for r in R.frequency_clusters(df, ["ntor"], "omega", "mode_id", hot=h).collect()}
    whole = found(10**9)
    assert len(whole) == len(rows) and found(hot) == whole


def test_bounds_are_the_least_values_that_do_not_join():
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(size=300), 10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 300)), [0.0, 1e-12, -1e-12, 5e-324]])
    b = chains.bounds(a, 0.02)
    assert (b > a).all() and not chains.joins(b, a, 0.02).any() and chains.joins(np.nextafter(b, -np.inf), a, 0.02).all()
