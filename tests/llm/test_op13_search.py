import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from modesift.llm import op13_search as S

from .test_op11_decontaminate import words


def brute(docs, items, k=10):
    held = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocab = ["Alpha", "é", "日本", "the"] + [f"w{i}" for i in range(30)]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in rng.sample(range(1000), n)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), docs[3], (5000, docs[1][1]), (2000, None), (2001, ""), (2002, " .- ")]
    items = [(i, text(rng.randint(1, 9))) for i in range(8)] + [(3, text(4)), (None, text(3)), (20, None), (21, ""), (22, "unseen terms"), (23, "THE the the alpha")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")


def ranked(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,args", [(1, {}), (2, {"vocabulary": 0}), (3, {"words": 12}), (4, {"k": 3})])
def test_ranks_match_brute_force(spark, seed, args):
    docs, items = corpus(seed)
    assert ranked(S.rank(*frames(spark, docs, items), **args)) == brute(docs, items, args.get("k", 10))


@pytest.mark.parametrize("seed", range(3))
def test_many_small_segments_blocks_and_spans(monkeypatch, seed):
    for name, value in (("DOCS", 11), ("BLOCK", 2), ("SPAN", 3)):
        monkeypatch.setattr(S, name, value)
    docs, items = corpus(seed, 120)
    schema = pa.schema([("docs", pa.list_(pa.int64())), *((n, t) for n, t in (("n_docs", pa.int64()), ("n_words", pa.int64()), ("lens", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("heads", pa.struct([(h, pa.list_(pa.int64())) for h in ("at", "size", "first", "most", "least", "gap_bytes", "tf_bytes")])), ("postings", pa.binary())))])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["id", "text"])
    rows = [r for b in S._indexer(None, "id", schema)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) > 5 and max(r["n_docs"] for r in rows) <= 11
    n_docs, n_words = sum(r["n_docs"] for r in rows), sum(r["n_words"] for r in rows)
    df = Counter()
    for r in rows:
        df.update(dict(zip(r["terms"], r["df"], strict=True)))
    got = []
    for item, text in items:
        best = []
        for r in rows:
            best = S.search(S.Segment(r, n_docs, n_words), [(t, c * S.weight(n_docs, df[t])) for t, c in Counter(words(text)).items() if t in df], best, 10)
        got += [(item, k + 1, d, s) for k, (s, d) in enumerate(best)]
    assert sorted(got, key=str) == brute(docs, items)


def test_postings_come_back():
    built = S.Builder()
    texts = {7: "a b a " * 200, 3: "b " * 70_000, 900: "c a", 4: "b c"}
    for d, t in texts.items():
        built.add(d, t.encode(), None)
    row = built.segment(pa.int64())
    row["docs"] = row["docs"][0].as_py()
    segment = S.Segment(row, 4, 70_604)
    assert segment.docs == [3, 4, 7, 900]
    held = {t: sum((segment.block(b)[0].tolist() for b in range(segment.start[k], segment.start[k + 1])), []) for t, k in segment.place.items()}
    assert held == {"a": [2, 3], "b": [0, 1, 2], "c": [1, 3]}
    assert segment.heads["tf_bytes"][segment.start[segment.place["b"]]] == 4


def test_large_products_keep_64_bits():
    assert S.norm(S.np.array([10**9, 1]), 10**12, 10**13).tolist() == [25 + 75 * 10**8, 25 + 7]


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(5)
    d, i = frames(spark, docs, items)
    assert S.rank(d.where("false"), i).count() == 0 and S.rank(d, i.where("false")).count() == 0
    extra = d.selectExpr("*", "1 as score", "'x' as terms", "2 as rank", "3 as item_id", "4 as id")
    assert ranked(S.rank(extra, i.selectExpr("*", "0 as number", "1 as doc_id"))) == brute(docs, items)
