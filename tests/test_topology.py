import numpy as np
from pyspark.sql import functions as F

from modesift.functions import arrays as A
from modesift.functions import profiles as P
from modesift.operators import features as X


def loop_turns(values, sign):
    """Inner maxima or minima, run by run, equal neighbours merged."""
    found = 0
    for b in P.blocks(np.isfinite(values)):
        v = sign * values[b]
        v = v[np.append(True, np.diff(v) != 0)]
        found += sum(v[i - 1] < v[i] > v[i + 1] for i in range(1, len(v) - 1))
    return found


def test_array_functions_equal_loops(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        v = rng.integers(0, 4, size=1 + i % 17).astype(float)
        rows.append((i, [None if rng.random() < 0.15 else float(x) for x in v]))
    a = F.col("a")
    got = spark.createDataFrame(rows, "id int, a array<double>").select("id", A.smooth5(a).alias("s"), A.monotonicity(a).alias("m"), A.turns(a, 1).alias("up"), A.turns(a, -1).alias("down")).collect()
    for r in got:
        v = np.array([np.nan if x is None else x for x in rows[r.id][1]])
        np.testing.assert_allclose(np.array([np.nan if x is None else x for x in r.s]), P.smooth(v), atol=1e-12)
        assert (r.up, r.down) == (loop_turns(v, 1), loop_turns(v, -1)), v
        step = np.diff(v)[np.isfinite(np.diff(v))]
        way = np.abs(step).sum()
        assert r.m == (None if not len(step) else 1.0 if way == 0 else abs(step.sum()) / way)


def test_screen(spark):
    r = np.linspace(0, 1, 101)
    wavy = lambda t: 1 + 0.1 * np.sin(40 * r + t)
    wide = [(wavy(0) ** 2).tolist(), ((1.5 * wavy(3)) ** 2).tolist()]
    narrow = [(wavy(0) ** 2).tolist(), ((1.1 * wavy(0)) ** 2).tolist()]
    slope = [((1 + 0.1 * r) ** 2).tolist(), ((2 + 0.1 * r) ** 2).tolist()]
    shots = {"all": [wide] * 5, "narrow": [wide] * 4 + [narrow], "slope": [slope] * 5, "short": [wide] * 4}
    rows = [(shot, 6 + k, *pair) for shot, pairs in shots.items() for k, pair in enumerate(pairs)]
    rows += [("all", 5, *narrow), ("all", 6, *narrow), ("none", 6, None, None), ("none", 7, [], []), ("none", 8, [1.0], [2.0]), ("none", 9, [None] * 50, [None] * 50), ("none", 10, [-1.0] * 50, [2.0] * 50)]
    d = spark.createDataFrame(rows, "shot string, n int, low2 array<double>, high2 array<double>")
    got = {r.shot: (r.n_groups, r.n_suitable, r.passes) for r in X.topology_screen(d).collect()}
    assert got == {"all": (5, 5, True), "narrow": (5, 4, False), "slope": (5, 0, False), "short": (4, 4, False), "none": (5, 0, False)}
    one = X.topology(d.where("shot = 'slope' and n = 6")).first()
    assert abs(one.edge_monotonicity - 1) < 1e-9 and one.extremum_pairs == 0 and 0.6 < one.gap_width_median < 0.7
    odd = X.topology(d.where("shot = 'none'")).collect()
    assert all(x.gap_width_median is None and x.edge_monotonicity is None and x.extremum_pairs == 0 for x in odd)
    assert not X.topology_screen(d.where("false")).collect()
