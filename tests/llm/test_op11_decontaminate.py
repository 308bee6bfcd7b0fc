import random
import re

import numpy as np
import pytest

from modesift.llm import op11_decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "é", "日本", "x1", "the", "of", "ñu", "42", "Z"] + [f"w{i}" for i in range(20)]
    gap = lambda: rng.choice([" ", ", ", "\n", "-", " \x00 ", "'"])
    text = lambda n: "".join(rng.choice(vocab) + gap() for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(12)] + [(3, text(9)), (None, text(8)), (90, None), (91, " .!"), (92, "")]
    items += [(93, items[2][1]), (94, text(40))]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 40))
        for _ in range(rng.choice([0, 1, 1, 3])):
            body += rng.choice(items)[1] or ""
            body = body.swapcase() if rng.random() < 0.3 else body
            body += text(rng.randint(0, 6))
        docs.append((i, body))
    return docs + [(100, None), (101, ""), (None, items[0][1]), (7, items[1][1]), (7, items[1][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")


def found(df):
    return sorted(((r.doc_id, r.leak__found.n_words, sum(x.last - x.first for x in r.leak__found.ranges), list(r.leak__found["items"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,size", [(1, D.WORDS), (2, D.WORDS), (3, 40)])
def test_scan_matches_brute_force(spark, seed, size):
    docs, items = corpus(seed)
    assert found(D.scan(*frames(spark, docs, items), width=5, words=size)) == brute(docs, items, 5)


def test_items_cut_to_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 6)
    docs, items = corpus(4)
    assert found(D.scan(*frames(spark, docs, items), width=5, words=30)) == brute(docs, items, 5)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "_hash", lambda ids, at, length: np.full(len(at), 7, dtype=np.uint64))
    docs, items = corpus(5)
    items = [(i, t) for i, t in items if words(t)]
    w = D.Windows([None if i is None else str(i) for i, _ in items], [" ".join(words(t)) for _, t in items], 5)
    got = w.find([(t or "").encode() for _, t in docs])
    want = {(n, h, tuple(x)) for _, n, h, x in brute(docs, items, 5)}
    assert {(n, sum(x["last"] - x["first"] for x in r), tuple(sorted(i))) for n, i, r in got} == want


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 8)
    text = "alpha beta  gamma " * 9 + "x" * 50 + " end"
    assert [w.decode() for part in D.words_of(text.encode()) for w in part] == words(text)


def test_ranges_place_the_words_and_are_removed(spark):
    docs = [(1, "Keep ü this. ONE two-three four FIVE six; keep that"), (2, None), (3, "one two three"), (4, "one two three four five six one two three four five")]
    d, i = frames(spark, docs, [(1, "one two three four five six")])
    spans = {r.doc_id: [(x.start, x.end) for x in r.leak__found.ranges] for r in D.scan(d, i, width=5).collect()}
    assert spans[1] == [(13, 40)] and docs[0][1][13:40] == "ONE two-three four FIVE six" and spans[4] == [(0, len(docs[3][1]))]
    assert {r.doc_id: r.text for r in D.without_spans(d, i, width=5).collect()} == {1: "Keep ü this.  ; keep that", 2: None, 3: "one two three", 4: " "}
    assert {r.doc_id for r in D.without_documents(d, i, width=5).collect()} == {2, 3}
    assert {r.doc_id for r in D.without_documents(d, i, share=0.6, width=5).collect()} == {1, 2, 3}


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(6)
    d, i = frames(spark, docs, items)
    assert found(D.scan(d, i.where("false"), width=5)) == brute(docs, [], 5)
    assert D.scan(d.where("false"), i, width=5).count() == 0
    extra = d.selectExpr("*", "doc_id as n_words", "'k' as items", "1 as item")
    out = D.scan(extra, i, width=5)
    assert out.columns == [*extra.columns, "leak__found"] and out.where("items <> 'k' or item <> 1 or not n_words <=> doc_id").count() == 0
