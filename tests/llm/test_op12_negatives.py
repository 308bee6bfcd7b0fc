import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modesift.llm import op12_negatives as M


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    held = [(k, i, y, [math.floor(256 * x) for x in v]) for k, (i, v, y) in enumerate(rows) if None not in (i, v, y) and v and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for k, i, y, v in held:
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, z) for n, j, z, w in held if n != k and len(v) == len(w))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=260, dim=6, classes=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(classes, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(classes))
        v = (centre[c] + rng.normal(size=dim) * rng.choice([0.05, 0.5])).round(2)
        rows.append((i, [float(x) for x in v], c if rng.random() < 0.8 else int(rng.integers(classes))))
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (None, rows[0][1], 1), (n + 2, [1.0, None] + [0.0] * (dim - 2), 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] * dim, 0), (n + 5, [], 0), (n + 6, [1e300] * dim, 0)]
    rows += [(n + 7, [0.0] * dim, 1), (n + 8, [1.0, 2.0], 1), (n + 20, [2.0, 1.0], 1), (n + 21, [1.5, 0.5], 2), rows[0], rows[0], rows[20]]
    random.Random(seed).shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_mining_matches_brute_force(spark, monkeypatch, seed, small):
    if small:  # many cells, groups and blocks
        for name, value in (("ANCHORS", 6), ("VALUES", 120), ("SAMPLED", 400), ("CELL", 20), ("CELLS", 8)):
            monkeypatch.setattr(M, name, value)
    rows = vectors(seed)
    assert found(M.mine(frame(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_few_rows_many_ties_and_other_columns(spark):
    rows = [(i, [1.0, 1.0], i % 3) for i in range(30)] + [(100, [0.0, 0.0], 0)]
    df = frame(spark, rows).selectExpr("*", "1 as id", "2 as rid", "'c' as cell", "4 as score")
    got = found(M.mine(df, F.col("vec_id") % 10 == 0, high=100))
    assert got and got == brute(rows, lambda i: i % 10 == 0, high=100)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(None, None, None)]])
def test_nothing_to_mine(spark, rows):
    out = M.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def search_input(rng, n, a, dim, spread):
    centre = rng.normal(size=(12, dim)) * 300
    pick = lambda n: (centre[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * spread).astype(np.int64)
    rows = {"rid": np.arange(n), "id": rng.permutation(n), "label": rng.integers(3, size=n), "vec": pick(n)}
    return {"rid": np.arange(a) + n, "label": rng.integers(3, size=a), "vec": pick(a)}, rows


@pytest.mark.parametrize("same,spread", [(True, 8), (False, 8), (True, 300), (False, 300)])
def test_pairs_of_nodes_are_pruned_and_nothing_is_lost(same, spread):
    anchors, rows = search_input(np.random.default_rng(5), 3000, 200, 8, spread)
    s = anchors["vec"] @ rows["vec"].T
    fits = (anchors["label"][:, None] == rows["label"][None, :]) == same
    high = np.sort(s, axis=1)[:, [-1, -60]]
    low = np.sort(s, axis=1)[:, [-40, -150]]
    stats = {}
    at, question, score, ids = M.dual_search(anchors | {"low": low, "high": high}, rows, 4, same, stats)
    want = []
    for k in range(len(s)):
        for q in range(2):
            ok = np.flatnonzero(fits[k] & (s[k] >= low[k, q]) & (s[k] <= high[k, q]))
            want += [(k, q, -x, i) for x, i in sorted(zip((-s[k, ok]).tolist(), rows["id"][ok].tolist(), strict=True))[:4]]
    assert sorted(zip(at.tolist(), question.tolist(), score.tolist(), ids.tolist(), strict=True)) == sorted(want)
    if spread == 8:
        assert stats["scored"] < stats["pairs"] / 2


def test_intervals_hold_all_products():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.normal(size=(9, 5)) * 100 + rng.normal(size=5) * 300, rng.normal(size=(7, 5)) * 10
        (ma, ra), (mb, rb) = M._balls(a, np.array([0, 9])), M._balls(b, np.array([0, 7]))
        lo, hi = M.interval(ma, ra, mb, rb)
        assert lo[0] <= (a @ b.T).min() and (a @ b.T).max() <= hi[0]


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**27 + 1, 3]], dtype=np.int64)
    assert M.products(a, a)[0, 0] == (2**27 + 1) ** 2 + 9
