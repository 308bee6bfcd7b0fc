import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from modesift.llm import op6_ctw


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows, depth=op6_ctw.DEPTH):
    """Trees by recursion over explicit contexts."""
    train = [(t or "").encode().lower() for i, t in rows if not held(i)]
    pad = b"\xff" * depth
    counts = defaultdict(lambda: [0, 0])
    contexts = defaultdict(set)
    for t in train:
        s = pad + t + b"\xff"
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                c = s[p - d : p]
                for k in range(8):
                    node = (1 << k) | (s[p] >> (8 - k))
                    counts[c, node][(s[p] >> (7 - k)) & 1] += 1
                    if d:
                        contexts[c[1:], node].add(c)
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(*counts[c, node])
            if len(c) == depth:
                memo[c, node] = own
            else:
                memo[c, node] = np.logaddexp(own, sum(weighted(x, node) for x in contexts[c, node])) - math.log(2)
        return memo[c, node]

    def predict(past, node, d=0):
        c = past[len(past) - d :]
        if (c, node) not in counts:
            return None
        a, b = counts[c, node]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        below = predict(past, node, d + 1)
        if below is None:
            return own
        w = 1 / (1 + math.exp(min(700, sum(weighted(x, node) for x in contexts[c, node]) - kt(a, b))))
        return w * own + (1 - w) * below

    tokens = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for i, t in rows:
        raw = (t or "").encode().lower()
        s, total = pad + raw + b"\xff", 0.0
        for p in range(depth, len(s)):
            for k in range(8):
                q = predict(s[p - depth : p], (1 << k) | (s[p] >> (8 - k)))
                q = 0.5 if q is None else q
                total += math.log10(q if (s[p] >> (7 - k)) & 1 else 1 - q)
        own = [*raw.split(), None]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own)
        out.append((i, held(i), len(own), sum(tokens[w] > 0 for w in own), n, round(base, 6), round(total, 3)))
    return out


def corpus():
    rng = random.Random(7)
    words = ["the", "of", "thing", "ring", "é", "Ünder", "bring", "a", "xyzzy"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)]
    return [*rows, (40, None), (41, ""), (42, " \n"), (3, rows[3][1]), (None, "the"), (43, "qqq\x00w zz")]


SCHEMA = "doc_id long, text string, held_out boolean, word string, key string, score double"
COLUMNS = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def scored(spark, rows, parts=None, **options):
    df = spark.createDataFrame([(i, t, held(i), "x", "y", 0.0) for i, t in rows], SCHEMA)
    out = op6_ctw.score(df.repartition(parts) if parts else df, **options).select(*COLUMNS).collect()
    return sorted(map(tuple, out), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[5]))


def test_scores_match_brute_force(spark):
    rows = corpus()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    text = {i: t for i, t in rows}
    for a, b in zip(scored(spark, rows), sorted(brute(rows), key=key), strict=True):
        assert (a[0], held(a[0]), *a[1:4]) == b[:5]
        assert a[4:6] == pytest.approx(b[5:], abs=1e-3)
        assert a[6] == pytest.approx(-a[5] * math.log2(10) / (len((text[a[0]] or "").encode()) + 1))


def test_equal_bit_for_bit_however_dealt(spark):
    """Whether strings and words are broadcast or joined, whatever the partitions and the runs of contexts."""
    rows = corpus()
    want = scored(spark, rows)
    assert want == scored(spark, rows, parts=7, string_share=1, word_share=1, part=5)  # all joined
    assert want == scored(spark, rows, parts=2, string_share=64, word_share=8, part=50)
    assert want == scored(spark, rows[::-1], parts=1)


def test_long_texts(spark):
    rng = random.Random(1)
    rows = [(i, "the bring of thing") for i in range(20)] + [(50, " ".join(rng.choices("ab cde fgh".split(), k=200_000))), (51, "y" * 3_000_000)]
    out = {r[0]: r for r in scored(spark, rows)}
    assert out[50][1] == 200_001 and out[51][1] == 2 and out[51][6] < 1


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert op6_ctw.score(spark.createDataFrame([], schema)).count() == 0
    r = op6_ctw.score(spark.createDataFrame([(1, "ab", True)], schema)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
    assert r.score == pytest.approx(-24 * math.log10(2), abs=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 7.5, 20, 1e4, 1e9])
    assert np.allclose(op6_ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
