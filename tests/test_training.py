"""Gradients against finite differences, the rate's course, and training on a fixture."""

import numpy as np
import pytest

from modesift.functions import cnn as C
from modesift.functions import grad as G
from modesift.operators import ml
from modesift.plans import training as T


@pytest.mark.parametrize("kind", ["raw", "raw3", "branch", "hybrid"])
def test_gradients_against_finite_differences(kind):
    rng = np.random.default_rng(2)
    p = {k: np.asarray(v, dtype=float) for k, v in C.random_weights(kind, 1).items()}
    x = rng.normal(size=(3 if kind == "raw3" else 1, 9, 13))
    beside = rng.normal(size=(4, 13)) if kind == "branch" else rng.normal(size=8) if kind == "hybrid" else None
    forward = {"branch": lambda q: C.with_branch(q, x, beside), "hybrid": lambda q: C.hybrid(q, x, beside)}.get(kind, lambda q: C.small(q, x))
    z, back = G.logit(p, kind, x, beside)
    assert z == pytest.approx(forward(p), abs=1e-9)
    value, g = G.loss(z, 1.0, 2.5)
    grads = back(g)
    assert set(grads) == set(p) and all(grads[k].shape == p[k].shape for k in p)
    for k in p:
        for at in rng.choice(p[k].size, min(4, p[k].size), replace=False):
            place = np.unravel_index(at, p[k].shape)
            ends = []
            for e in (1e-5, -1e-5):
                q = p | {k: p[k].copy()}
                q[k][place] += e
                ends.append(G.loss(forward(q), 1.0, 2.5)[0])
            assert grads[k][place] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6, rel=1e-4), (k, place)


def test_pool_gives_the_gradient_to_the_first_largest():
    x = np.array([[[1.0, 1.0, 5.0], [0.0, 1.0, 9.0], [7.0, 7.0, 7.0]]])
    out, back = G.pool(x)
    assert out.tolist() == C.pool(x).tolist() == [[[1.0]]]
    assert back(np.array([[[2.0]]]), {}).tolist() == [[[2.0, 0, 0], [0, 0, 0], [0, 0, 0]]]


def test_rate_and_step():
    rates = [G.one_cycle(k, 100, 1.0) for k in range(100)]
    assert rates[0] == pytest.approx(0.05) and rates[9] == pytest.approx(1.0) and rates[-1] == pytest.approx(0.0005) and np.argmax(rates) == 9
    assert (np.diff(rates[9:]) < 0).all() and G.one_cycle(0, 1, 1.0) > 0
    p = {"a": np.array([1.0, 2.0])}
    adam = G.Adam(p)
    out = adam.step(p, {"a": np.array([30.0, -40.0])}, 0.1, clip=1.0)
    assert adam.m["a"] == pytest.approx([0.06, -0.08], rel=1e-4) and out["a"] == pytest.approx([0.9, 2.1], rel=1e-4)


def test_partial_sums_and_training(spark):
    rng = np.random.default_rng(5)
    r = np.linspace(0, 1, 16)
    rows = []
    for i in range(60):
        y = i % 2
        mode = np.stack([(h + 1) * np.exp(-(((r - (0.3 if y else 0.7)) / 0.15) ** 2)) for h in range(4)]) + rng.normal(size=(4, 16)) * 0.1
        rows.append((f"p{i}", y if i < 56 else None, mode.tolist() if i != 3 else None, 1.0, [0.25] * 16, [2.25] * 16))
    df = spark.createDataFrame(rows, "path string, y int, mode array<array<double>>, omega double, low2 array<double>, high2 array<double>").repartition(4)
    t = T.Training(rows=8, cols=16, how="maxabs", epochs=6, batch=16, rate=0.02, dropout=0.0, positive_weight="auto", seed=1)
    made = T.inputs(df, "raw", "path", "y", t)
    assert made.count() == 55
    p = {k: np.asarray(v, dtype=float) for k, v in C.random_weights("raw", 1).items()}
    want = None
    for k in made.collect():
        z, back = G.logit(p, "raw", np.array(k.x, dtype=float).reshape(1, 8, 16))
        own = T._flat(back(G.loss(z, float(k.y), 1.0)[1]))
        want = own if want is None else want + own
    n, _, _, got = T._pass(made.repartition(40), p, "raw", t, 1.0, 0)  # more partitions than one stage adds
    assert n == 55 and np.allclose(got, want)
    fitted = T.train_array_model(df, "raw", settings=t)
    assert len(fitted.history) == 6 and fitted.history[-1]["loss"] < 0.7 * fitted.history[0]["loss"]
    assert fitted.history[fitted.epoch - 1]["accuracy"] == max(h["accuracy"] for h in fitted.history)
    scored = ml.score_array_model(df.where("y is not null"), fitted.weights, rows=8, cols=16, how="maxabs")
    assert scored.where("p_cnn is not null and (p_cnn >= 0.5) = (y = 1)").count() >= 50
    with pytest.raises(ValueError):
        T.train_array_model(df.where("y = 1"), "raw", settings=t)
