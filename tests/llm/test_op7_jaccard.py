import random

import numpy as np
import pytest

from modesift.llm import op7_jaccard
from modesift.llm.common import shingle_sets


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=30)
    rows, i = [], 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(3, 160))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = passage + words
            rows.append((i, " ".join(words) if rng.random() < 0.9 else " \n".join(words).upper()))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "a"), (i + 4, "A "), (i + 5, "a b"), (i + 6, "b a"), (i + 7, "é É")]
    return rows


@pytest.mark.parametrize("width,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2)])
def test_components_match_brute_force(spark, width, num, den, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sid string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_jaccard.join(df, width=width, num=num, den=den).collect()}
    assert got == brute(rows, width, num, den)


def test_blocks_of_a_hot_leader_lose_nothing(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(op7_jaccard, "GROUP", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_jaccard.join(df).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_trie_finds_all_partners():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(120)]
    sets = [s for k, s in enumerate(sets) if not any(np.array_equal(s, t) for t in sets[:k])]
    trie = op7_jaccard.Trie(sets)
    for s in sets:
        want = {k for k, t in enumerate(sets) if 10 * len(np.intersect1d(s, t)) >= 6 * len(np.union1d(s, t))}
        assert set(trie.search(s, 60, 6, 10).tolist()) == want


def test_keep_one(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang")
    out = op7_jaccard.keep_one(df).collect()
    want = {i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c}
    assert sorted(r.doc_id for r in out) == sorted(want)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op7_jaccard.join(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (5, "A b c d"), (5, "a b c d")], "doc_id long, text string")
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in op7_jaccard.join(df).orderBy("doc_id").collect()] == [(None, 2, 5), (5, 2, 5), (5, 2, 5)]


def test_short_texts_are_one_shingle():
    assert [len(s) for s in shingle_sets([b"", b"a", b"a b", b"a b c", b"a b c d"], 3)] == [0, 1, 1, 1, 2]
