import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modesift.llm import op8_graph
from modesift.llm.common import Scratch


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and i is not None and None not in v and len(v) == 16 and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v) != 0)]
    x = np.stack([v for _, v in ok])
    s = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    near = s >= cosine
    label = np.arange(len(ok))
    order = np.argsort([i for i, _ in ok])
    ids = np.array([i for i, _ in ok])
    comp = ids.copy()
    for _ in range(len(ok)):
        new = np.array([comp[near[k]].min() for k in range(len(ok))])
        if (new == comp).all():
            break
        comp = new
    del label, order
    return {int(i): (int(near[k].sum()) - 1, int(comp[k])) for k, i in enumerate(ids)}


def corpus(n=900, d=16, seed=4):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        base = rng.normal(size=d)
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 60]))):
            rows.append((i, [float(np.float32(v)) for v in (base + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.15])) * rng.choice([1.0, 3.0])]))
            i += 1
    bad = [None, [0.0] * d, [1.0] * (d - 1) + [None], [1.0] * (d - 1) + [float("nan")], [1.0] * (d - 1) + [float("inf")], [1.0] * 3]
    return rows, [(n * 10 + k, v) for k, v in enumerate(bad)]


def held(out, want, least):
    """No false link, recall, links that agree with their components, and equal ends."""
    there = sum(n for n, _ in want.values())
    assert all(out[i].n_links <= n for i, (n, _) in want.items())
    assert sum(out[i].n_links for i in want) >= least * there
    assert sum(out[i].component_id == c for i, (_, c) in want.items()) >= least * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_links_and_components(spark):
    rows, bad = corpus()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in op8_graph.near_duplicates(df, shard=450).collect()}
    want = brute(rows)
    assert len(out) == len(rows) + len(bad)
    for i, _ in bad:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    held(out, want, 0.99)
    assert out[rows[0][0]].recall >= 0.9


def test_many_shards_and_little_overlap(spark):
    """Twenty cells of which a vector is dealt to three."""
    rows, _ = corpus(3000, seed=5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in op8_graph.near_duplicates(df, shard=150).collect()}
    held(out, brute(rows), 0.98)
    assert out[rows[0][0]].recall >= 0.9


def test_blocks_of_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(op8_graph, "LEVELS", 0)
    rows, _ = corpus(400, seed=6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held({r.vec_id: r for r in op8_graph.near_duplicates(df, shard=200, group=100).collect()}, brute(rows), 0.97)


def test_cells_grow_with_the_data(spark):
    """Fits of at most four centres: cells are divided level by level until none holds over 600 members."""
    rows, _ = corpus(4000, seed=9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in op8_graph.near_duplicates(df, shard=150, fan=4, group=600).collect()}
    held(out, brute(rows), 0.97)
    assert min(out[0].recall, out[0].vector_recall) >= 0.9
    scratch = Scratch(spark)
    classes = scratch.write(df.select(F.col("vec_id").alias("sid"), F.lit(1).cast("long").alias("mult"), F.transform("embedding", lambda v: v.cast("double")).alias("vec")))
    fitted = spark.sparkContext.broadcast(op8_graph._fit(classes, {16: len(rows)}, 150, 4, 0.9))
    first = op8_graph._members(classes, fitted, 3)
    second = scratch.write(op8_graph._finer(first, 0, 3, 0.9, 150, 4, 600))
    third = scratch.write(op8_graph._finer(second, 1, 3, 0.9, 150, 4, 600))
    cells = [m.select("shard").distinct().count() for m in (first, second, third)]
    assert cells[0] <= 4 < 4 * 2 <= cells[1] < cells[2]
    for m in (second, third):
        per = m.groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("d"), F.sum(F.col("home").cast("int")).alias("h")).collect()
        assert len(per) == len(rows) and all(r.h == 1 and r.n == r.d <= 3 for r in per)


def test_a_recall_that_stays_low_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(op8_graph, "audit_recall", lambda *a: (0.99, 0.5))
    df = spark.createDataFrame(corpus(60, seed=8)[0], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="recall"):
        op8_graph.near_duplicates(df)


def test_recall_of_vectors_sees_small_groups(spark):
    """A group of ten with all links, a pair without: 90 of 92 links, but five of six vectors."""
    vecs = [[1.0, 0.001 * k, 0.0] for k in range(10)] + [[0.0, 0.0, 1.0], [0.0, 0.1, 1.0]]
    df = spark.createDataFrame([(v, k, 1, 9 if k < 10 else 0) for k, v in enumerate(vecs)], "vec array<double>, sid long, mult long, links long")
    assert op8_graph.audit_recall(df, df, 100, 0.9) == pytest.approx((90 / 92, 10 / 12))


def test_lengths_and_sizes(spark):
    rows, _ = corpus(300, seed=7)
    other = [(9000, [1.0, 0.0]), (9001, [3.0, 0.1]), (9002, [0.0, 1.0]), (9003, [1.0, 0.0, 0.0])]
    large = [(9100, [1e200] * 16), (9101, [2e200] * 15 + [1.9e200]), (9102, [1e-300] * 16)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows + other + large], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in op8_graph.near_duplicates(df, shard=100).collect()}
    assert [(out[i].n_links, out[i].component_id) for i, _ in other] == [(1, 9000), (1, 9000), (0, 9002), (0, 9003)]
    assert [(out[i].n_links, out[i].component_id) for i, _ in large] == [(2, 9100)] * 3


def test_graph_finds_nearest(spark):
    """Beam search over the built graph against brute force."""
    rng = np.random.default_rng(2)
    x = op8_graph.unit(rng.normal(size=(1500, 24)))
    lists = op8_graph.build_graph(x, 16, 24)
    assert ((lists >= -1) & (lists < len(x))).all() and (lists != np.arange(len(x))[:, None]).all()
    got = op8_graph.beam_search(x, x, lists, op8_graph.medoids(x), 24)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    assert np.mean([s[i].argmax() in got[i] for i in range(len(x))]) >= 0.9


def test_a_tight_group_among_strangers_is_reached():
    """A group much nearer to itself than to all else has few edges from outside: medoids lead to it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x[::20] = x[0] + rng.normal(size=(200, 64)) * 0.2
    x = op8_graph.unit(x)
    lists = op8_graph.build_graph(x, 16, 24)
    met, walk = op8_graph.beam_search(x, x[::20], lists, op8_graph.medoids(x), 24), op8_graph.Walk(lists)
    for v, found in zip(range(0, 4000, 20), met, strict=True):
        near = np.flatnonzero(x @ x[v] >= 0.9)
        entries = found[(found >= 0) & (found != v)]
        assert len(walk.expand(x, v, entries[x[entries] @ x[v] >= 0.9], 0.9)) >= 0.95 * (len(near) - 1)


def test_counts_agree_at_both_ends():
    rng = np.random.default_rng(3)
    home = rng.random(37) < 0.8
    links, mult = op8_graph.Links(home), rng.integers(1, 4, 37)
    want = np.zeros((37, 37), dtype=bool)
    for v in np.flatnonzero(home):
        found = np.flatnonzero(rng.random(37) < 0.1)
        found = found[found != v]
        links.add(int(v), found)
        want[v, found] = True
    both = want | want.T
    assert (links.counts(mult) == (both[np.ix_(home, home)] @ mult[home])).all()


def test_copies_and_empty(spark):
    v = [1.0] + [0.0] * 15
    df = spark.createDataFrame([(4, v), (2, v), (2, v), (None, v)], "vec_id long, embedding array<float>")
    out = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in op8_graph.near_duplicates(df).collect())
    assert out == [(False, 2, 2, 2, True), (False, 2, 2, 2, True), (False, 4, 2, 2, False), (True, 0, 0, None, True)]
    assert op8_graph.near_duplicates(df.where("vec_id > 100")).count() == 0


def test_a_group_over_many_centres(spark):
    """A third of 60,000 vectors are different near copies of one vector: far more than three shards hold."""
    rng = np.random.default_rng(3)
    n, d = 60_000, 64
    x = rng.normal(size=(n, d))
    group = np.arange(0, n, 3)
    base = rng.normal(size=d)
    x[group] = base / np.linalg.norm(base) + rng.normal(size=(len(group), d)) * 0.27 / np.sqrt(d)
    x = x.astype(np.float32).astype(np.float64)
    u = x[group] / np.linalg.norm(x[group], axis=1)[:, None]
    want = np.concatenate([(u[k : k + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(u), 1000)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>")
    out = op8_graph.near_duplicates(df).select("vec_id", "n_links", "recall").toPandas().set_index("vec_id")
    got = out.loc[group, "n_links"].to_numpy()
    assert (got <= want).all()
    assert got.sum() >= 0.99 * want.sum()
    assert out["recall"].iloc[0] >= 0.99
