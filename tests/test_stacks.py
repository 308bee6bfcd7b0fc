import numpy as np
import pytest
from pyspark.sql import functions as F

from modesift.functions import profiles as P
from modesift.functions import stacks as S
from modesift.operators import gates as G


def modes(kind, n, b=20, nhar=3):
    rng = np.random.default_rng(n)
    r = np.linspace(0, 1, n)
    if kind == "noise":
        return rng.normal(size=(b, nhar, n))
    if kind == "plateaus":
        return rng.integers(-2, 3, size=(b, nhar, n)).astype(float)
    if kind == "zero":
        return np.zeros((b, nhar, n))
    if kind == "within tolerance":  # steps of about the tolerance of a flat top
        return np.round(rng.normal(size=(b, nhar, n)), 1) + rng.integers(-1, 2, size=(b, nhar, n)) * P.EPS * rng.choice([0.3, 0.7, 1, 2, 3], size=(b, 1, 1))
    return np.exp(-(((r - rng.random((b, nhar, 1))) / rng.uniform(0.004, 0.2, (b, nhar, 1))) ** 2)) * rng.normal(size=(b, nhar, 1))


@pytest.mark.parametrize("kind", ["noise", "plateaus", "zero", "within tolerance", "lobes"])
@pytest.mark.parametrize("n", [2, 3, 7, 201])
def test_stacks_equal_single_modes(kind, n):
    stack = modes(kind, n)
    for name, arg in (("axis_artifact", 0.03), ("axis_artifact", 1.0), ("edge_artifact", 0.97), ("edge_artifact", 0.5), ("grid_spike", 0.0), ("grid_spike", 1.0), ("grid_spike", 2.5), ("grid_spike", 500.0)):
        got = getattr(S, name)(stack, arg)
        for i, mode in enumerate(stack):
            assert {k: v[i].item() for k, v in got.items() if not np.ma.getmaskarray(v)[i]} == getattr(P, name)(mode, arg)


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_measure_equals_single_modes(spark, monkeypatch, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        n = (21, 33)[i % 2]
        low = [None if rng.random() < 0.1 else float(v) for v in 0.5 + rng.random(n)]
        rows.append((i, modes("lobes", n, 1, 2 + i % 3)[0].tolist(), 1.0 + i / 60, low, [None if v is None else v + 0.4 for v in low], "kept"))
    rows += [(60, None, 1.0, [1.0], [1.0], "a"), (61, [[1.0, 2.0], [3.0]], 1.0, [1.0], [1.0], "a"), (62, [[1.0, float("nan")]], 1.0, [1.0, 1.0], [2.0, 2.0], "a"), (63, [[1.0, None]], 1.0, [1.0, 1.0], [2.0, 2.0], "a"), (64, [], 1.0, [], [], "a")]
    rows += [(65, [[1.0, 2.0]], None, [1.0, 1.0], [2.0, 2.0], "a"), (66, [[1.0, 2.0, 1.0]], 1.0, [1.0], [2.0], "a"), (67, [None, None], 1.0, [1.0], [2.0], "a"), (68, [[0.0, 0.0]], 1.0, [1.0, 1.0], [2.0, 2.0], "a")]
    schema = "id int, mode array<array<double>>, omega double, low2 array<double>, high2 array<double>, axis string"
    got = {r.id: r for r in G.measure(spark.createDataFrame(rows, schema).coalesce(2)).orderBy(F.desc("id")).collect()}
    assert len(got) == len(rows)
    cfg = G.GateConfig()
    for i, mode, omega, low, high, axis in rows:
        r = got[i].asDict()
        assert r["axis"] == axis
        if 60 <= i < 68 and i != 66:  # a single boundary value holds at every radius
            assert r["measure_error"] and r["axis_peak"] is None and r["ext_dr"] is None
        else:
            m = np.array(mode)
            want = G.measure_one(m, omega, G._array(low, m.shape[1]), G._array(high, m.shape[1]), cfg)
            assert {k: r[k] for k in want} == want and not r["measure_error"]
            assert all(r[name.split()[0]] is None for name in G.MEASURES.split(", ") if name.split()[0] not in want)
