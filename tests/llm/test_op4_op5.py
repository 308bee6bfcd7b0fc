import math
import random
import zlib

import numpy as np
import pytest

from modesift.llm import op4_toxicity as T
from modesift.llm import op5_quality as Q


def enumerated(read, factors):
    """The heaviest reading of a clause, over all paths of the three marking transducers one after the other."""
    def paths(fst, symbols):
        found = [(fst.start, ())]
        for s in symbols:
            found = [(to, (*out, o)) for state, out in found for o, _, to in fst.step(state, s)]
        return [out for state, out in found if state in fst.final]

    best = -math.inf
    for a in paths(T.negation(), read):
        for b in paths(T.frame(), a):
            for c in paths(T.aim(), b):
                hits = [s for s in c if type(s) is tuple]
                best = max(best, sum(0.0 if k == "threat" and "t" not in m else g * math.prod(factors[x] for x in m) for k, g, m in hits))
    return best


def test_composition_equals_all_paths():
    rng = random.Random(3)
    grammar = T.Grammar({}, T.DEFAULTS)
    words = ["other"] * 4 + ["target", "negation", "report", "quote", ("insult", 3, ""), ("insult", 7, ""), ("threat", 2, "")]
    for _ in range(400):
        read = rng.choices(words, k=rng.randint(1, 11))
        want = enumerated(read, T.DEFAULTS)
        assert grammar.fst.best(read)[0] == pytest.approx(want)
        assert grammar.best(read)[0] == pytest.approx(want)  # with runs of other words cut


def test_transducers():
    g = T.Grammar({"grob": 3.0})
    clauses = lambda text: [w for w, _ in g.clauses(text)]
    plain, = clauses("the grobian word")
    for text in ("you grobian word", "grobian that you are"):
        aimed, = clauses(text)
        assert aimed > plain
    negated, = clauses("not a grobian")
    reported, = clauses('he said "a grobian"')
    far, = clauses("not in all of this a grobian")
    assert negated < plain == far and reported < plain
    assert clauses("nothing here") == [] and clauses("I will kill time") == [0.0]
    assert clauses("I will kill you")[0] > clauses("I will not kill you")[0] > 0 and len(clauses("grob. grob! fine")) == 2
    assert clauses("") == [] and g.features("") == (0.0, 0.0)


def test_factors_are_learned():
    assert T.factors_of({}) == pytest.approx({"n": 0.6, "r": 0.7, "t": 1.25})
    learned = T.factors_of({("", 1): 900, ("", 0): 100, ("n", 1): 10, ("n", 0): 990, ("r", 1): 900, ("r", 0): 100})
    assert learned["n"] < 0.15 and learned["r"] > 0.95


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.1
        t = rng.choices(words, k=40)
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), "zurgo" + "".join(rng.choices("klm", k=3)))
        rows.append((i, " ".join(t) + ".", f"s{i % 4}", "en"))
        labels.append((i, int(rng.random() < 0.8), int(toxic)))
    return rows, labels


def test_learns_inflected_words(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    ys = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon, factors, fit = T.train(docs, ys)
    assert any("zurgo".startswith(p) for p in lexicon)
    found = {r.doc_id: r.toxicity__score for r in T.score(docs, lexicon, factors, fit).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.5) == bool(truth[i]) for i in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for s in found.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "you idiot"), (2, "you idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.train(docs, none)
    out = T.score(docs, *model).collect()
    assert len(out) == 4 and out[2].toxicity__score == out[3].toxicity__score > out[0].toxicity__score
    assert T.score(docs.limit(0), *model).count() == 0
    from pyspark.sql import functions as F

    q = Q.classify(docs.withColumn("h", F.lit("a")), none, F.col("h"), F.col("h")).collect()
    assert [r.quality__score for r in q] == [0.5] * 4


@pytest.mark.parametrize("folder,found,marked", [("sf0.01", 4, 0), ("sf0.1", 89, 2)])
def test_held_out_rows_and_single_clauses(spark, folder, found, marked):
    """What is missed has no word that the training rows of its language hold often enough."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"/root/testdata/{folder}/labels.parquet")
    lexicon, factors, fit = T.train(docs, labels)
    assert (fit[1:] >= 0).all() and fit[1:].max() > 0
    scores = {r.doc_id: r.toxicity__score for r in T.score(docs, lexicon, factors, fit).collect()}
    held = [(scores[r.doc_id] >= 0.5, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p for p, y in held if y == 1) >= found and sum(p for p, y in held if y == 0) <= marked
    grammar = T.Grammar(lexicon, factors)
    one = lambda text: 1 / (1 + np.exp(-(fit[0] + fit[1:] @ np.array(grammar.features(text)))))
    assert one("I will kill you") >= 0.5 and one("you idiot") >= 0.5 > one("they kill time") and one("you idiot") > one('she said "you idiot"')
    assert one("you idiot") > one("the idiot") > one("a plain sentence") and one("you idiot, you moron") > one("you idiot")


def test_query_on_data(spark):
    out = {r.doc_id: r for r in T.query(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    clean = [out[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert sum(clean) <= 0.01 * len(clean)
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)


def test_sample_bounds_rows_too(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, T.labelled(docs, labels, "toxic", 10).collect())) == [("b", 0), ("text 0", 1)]


def posterior(rows, labels):
    """Host and path rates by the formulae of the docstring."""
    y = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5}
    sites = {}
    for i, _, host, path in rows:
        if i in y:
            k, n = sites.get((host, path), (0, 0))
            sites[host, path] = (k + y[i], n + 1)
    k, n = (sum(x[j] for x in sites.values()) for j in (0, 1))
    whole = (k + 0.5) / (n + 1)

    def strength(groups):
        groups = [g for g in groups if g[1] > 1]
        ss = sum((k / n - m) ** 2 * n for k, n, m in groups)
        low, high = sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for _, n, m in groups)
        if high <= low or ss <= low:
            return 1e6
        r = min(0.999, (ss - low) / (high - low))
        return min(1e6, max(0.5, (1 - r) / r))

    hosts = {}
    for (h, _), (k, n) in sites.items():
        a, b = hosts.get(h, (0, 0))
        hosts[h] = (a + k, b + n)
    s = strength([(k, n, whole) for k, n in hosts.values()])
    hosts = {h: (k + s * whole) / (n + s) for h, (k, n) in hosts.items()}
    s = strength([(k, n, hosts[h]) for (h, _), (k, n) in sites.items()])
    return whole, hosts, {(h, p): (k + s * hosts[h]) / (n + s) for (h, p), (k, n) in sites.items()}


def test_posteriors_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        host, path = rng.choice(["a", "a", "a", "b", "c", None, *(f"h{k}" for k in range(12))]), rng.choice(["x", "y", None])
        rows.append((i, "words " * 5, host, path))
        if rng.random() < 0.7:
            labels.append((i, int(rng.random() < {"a": 0.9, "b": 0.2}.get(host, 0.6) - 0.1 * (path == "y")), 0))
    rows += [(9000, "w", "new", "x"), (9001, "w", "a", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    out = Q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("host"), F.col("path")).collect()
    whole, hosts, paths = posterior(rows, labels)
    logit = lambda p: math.log(p / (1 - p))
    for r in out:
        host = hosts.get(r.host, whole)
        path = paths.get((r.host, r.path), host)
        assert (r.quality__host, r.quality__path) == pytest.approx((host, path))
        assert logit(r.quality__score) == pytest.approx(logit(r.quality__own) + logit(path) - logit(whole))


def test_hosts_shrink(spark):
    rows, labels = [], []
    rng = random.Random(5)
    i = 0
    for host, rate, n in (("good", 0.95, 300), ("bad", 0.1, 300), ("tiny", 0.0, 2), *((f"h{k}", 0.6, 40) for k in range(10))):
        for _ in range(n):
            rows.append((i, "some words in a plain text. " * 3, host, "p"))
            labels.append((i, int(rng.random() < rate), 0))
            i += 1
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([*rows, (i, None, None, None)], "doc_id long, text string, host string, path string")
    out = Q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("host"), F.col("path"))
    rate = {r.host: r for r in out.select("host", "quality__host", "quality__path").distinct().collect()}
    assert rate["good"].quality__host > 0.85 and rate["bad"].quality__host < 0.2
    assert 0.2 < rate["tiny"].quality__host < 0.65  # two rows prove little
    assert rate[None].quality__host == pytest.approx(rate[None].quality__path)


def test_quality_on_data(spark):
    out = {r.doc_id: r for r in Q.query(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if out[r.doc_id].held_out]
    assert sum(out[r.doc_id].predicted == r.quality for r in labels) >= 0.93 * len(labels)
