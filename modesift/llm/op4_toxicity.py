"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five weighted transducers are composed. The lexicon reads a clause's words and writes classes: insults
and threats with a grade (the rounded log odds of the word's beginning), targets, negation, verbs of
saying, quotation marks. The negation transducer marks hits up to three words behind a negation, the
frame transducer those in quotation marks after a verb of saying, the target transducer those in a
clause that is aimed at someone, wherever the target stands (it guesses, and a guess that no target
confirms doesn't end in a final state). The last one weighs each marked hit: its grade times a factor
for each mark; a threat without a target weighs nothing. A clause's score is the weight of its best
path through the composition, so the same word counts by the pattern it stands in. A document's features
are its strongest clause and the sum over clauses, and a logistic fit turns them into the score.
Nothing but the text is an input.

The lexicon, the factors and the logistic fit are learned from at most ``sample`` labelled documents
(drawn by a hash of the id, documented bound; 60,000), of which only the ids and labels are broadcast.
A beginning enters the lexicon if its excess in toxic documents would be met by chance in fewer than
one of a hundred corpora (Chernoff bound, corrected for the number of candidates), shortest beginnings
first; the words of ``SEEDS`` are in it besides. A mark's factor is the share of hits with it that stand
in toxic documents over that of hits without, shrunk to a default by ``PRIOR`` hits.

Defined results: null or empty text has no clause and gets the score of no evidence; null ids count as
held out or not by the crc of the empty text; of labelled rows that repeat an id the least text is
learned from, all get their scores; without any labels the default grammar scores alone; an empty table
gives no rows; extra columns pass through ``score``, names beginning with ``toxicity__`` are reserved.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, crc_mod, documents, draw, text_bytes, tidy

SAMPLE = 60_000
BLOCK = 1 << 21  # bytes of text taken out of a batch at once
CLAUSE = re.compile(r"[.!?;\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
SHORTEST, LONGEST = 4, 10

# Closed classes of the grammar in the four languages of the corpus, and seeds of the open ones with their grades.
TARGETS = frozenset("you your yours yourself u ya du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
NEGATION = frozenset("not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORT = frozenset("said says called wrote claimed quoted sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split())
SEEDS = {w: ("threat", 6) for w in "kill hurt destroy beat töten schlagen tuer frapper matar golpear".split()} | {w: ("insult", 3) for w in "idiot moron scum stupid pathetic worthless disgusting".split()}
QUOTES = frozenset('"“”«»„')

HITS = ("insult", "threat")
GRADES = range(1, 10)
SCOPE = 3
#: Factors of the marks where nothing is learned: negated, reported, aimed at someone.
DEFAULTS = {"n": 0.6, "r": 0.7, "t": 1.25}
LIMITS = {"n": (0.1, 1.0), "r": (0.1, 1.0), "t": (1.0, 2.0)}
PRIOR = 20.0


# --- transducers ---------------------------------------------------------------------------------


class Fst:
    """A weighted transducer: arcs by (state, input) as (output, weight, next state); a path's weight is
    the sum of its arcs' (max-plus). A state's arc for ANY reads all it has no arc of its own for and
    writes what it reads."""

    ANY = "*"

    def __init__(self, start, final: set, arcs: dict):
        self.start, self.final, self.arcs = start, final, arcs

    def step(self, state, symbol) -> list[tuple]:
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return [(symbol, w, to) for _, w, to in self.arcs.get((state, self.ANY), [])]

    def compose(self, other: "Fst", symbols) -> "Fst":
        """The transducer that feeds what this one writes to the other, over the given input symbols."""
        start = (self.start, other.start)
        arcs, todo, known = {}, [start], {start}
        while todo:
            at = todo.pop()
            for symbol in symbols:
                out = [(o2, w1 + w2, (to1, to2)) for o1, w1, to1 in self.step(at[0], symbol) for o2, w2, to2 in other.step(at[1], o1)]
                if out:
                    arcs[at, symbol] = out
                    for *_, to in out:
                        if to not in known:
                            known.add(to)
                            todo.append(to)
        return Fst(start, {s for s in known if s[0] in self.final and s[1] in other.final}, arcs)

    def best(self, symbols) -> tuple[float, tuple]:
        """Weight and output of the best path that ends in a final state; (-inf, ()) where none does."""
        held = {self.start: (0.0, ())}
        for symbol in symbols:
            after: dict = {}
            for state, (w, out) in held.items():
                for o, v, to in self.step(state, symbol):
                    if to not in after or w + v > after[to][0]:
                        after[to] = (w + v, (*out, o))
            held = after
        return max((x for s, x in held.items() if s in self.final), default=(-math.inf, ()))


def _hits() -> list[tuple[str, int, str]]:
    """Symbols of hits: class, grade and marks, none at first."""
    return [(kind, g, "") for kind in HITS for g in GRADES]


SYMBOLS = ["other", "target", "negation", "report", "quote", *_hits()]


def _marked(symbol, mark: str):
    return (symbol[0], symbol[1], symbol[2] + mark)


def _all_marks(marks: str) -> list[tuple[str, int, str]]:
    out = _hits()
    for m in marks:
        out += [_marked(s, m) for s in out]
    return out


def negation(scope: int = SCOPE) -> Fst:
    """States count the words that a negation still reaches."""
    arcs = {}
    for left in range(scope + 1):
        down = max(0, left - 1)
        arcs[left, Fst.ANY] = [("", 0.0, down)]
        arcs[left, "negation"] = [("negation", 0.0, scope)]
        for s in _hits() if left else []:
            arcs[left, s] = [(_marked(s, "n"), 0.0, down)]
    return Fst(0, set(range(scope + 1)), arcs)


def frame() -> Fst:
    """States: whether something was said, and whether quotation marks are open."""
    arcs = {}
    for said in (False, True):
        for inside in (False, True):
            at = (said, inside)
            arcs[at, Fst.ANY] = [("", 0.0, at)]
            arcs[at, "report"] = [("report", 0.0, (True, inside))]
            arcs[at, "quote"] = [("quote", 0.0, (said, not inside))]
            for s in _all_marks("n") if said and inside else []:
                arcs[at, s] = [(_marked(s, "r"), 0.0, at)]
    return Fst((False, False), {(a, b) for a in (False, True) for b in (False, True)}, arcs)


def aim() -> Fst:
    """No target (read or wanted), one wanted, one read; all hits of a clause have it or none."""
    arcs = {("none", Fst.ANY): [("", 0.0, "none")], ("wanted", Fst.ANY): [("", 0.0, "wanted")], ("read", Fst.ANY): [("", 0.0, "read")]}
    for at in ("none", "wanted", "read"):
        arcs[at, "target"] = [("target", 0.0, "read")]
    arcs["bare", Fst.ANY] = [("", 0.0, "bare")]
    arcs["bare", "target"] = []
    for s in _all_marks("nr"):
        arcs["none", s] = [(s, 0.0, "bare"), (_marked(s, "t"), 0.0, "wanted")]
        arcs["bare", s] = [(s, 0.0, "bare")]
        arcs["wanted", s] = [(_marked(s, "t"), 0.0, "wanted")]
        arcs["read", s] = [(_marked(s, "t"), 0.0, "read")]
    return Fst("none", {"none", "bare", "read"}, arcs)


def weigh(factors: dict[str, float]) -> Fst:
    """A hit's grade times the factors of its marks; a threat needs its target."""
    arcs = {(0, Fst.ANY): [("", 0.0, 0)]}
    for s in _all_marks("nrt"):
        weight = s[1] * math.prod(factors[m] for m in s[2])
        arcs[0, s] = [(s, 0.0 if s[0] == "threat" and "t" not in s[2] else weight, 0)]
    return Fst(0, {0}, arcs)


def marks() -> Fst:
    return negation().compose(frame(), SYMBOLS).compose(aim(), SYMBOLS)


class Grammar:
    """The composed transducers; lexicon maps word beginnings to log odds, factors marks to factors."""

    def __init__(self, lexicon: dict[str, float], factors: dict[str, float] | None = None):
        self.lexicon = {w: ("insult", min(GRADES[-1], max(GRADES[0], round(v)))) for w, v in lexicon.items()}
        self.longest = max((len(p) for p in lexicon), default=0)
        self.fst = marks().compose(weigh(factors or DEFAULTS), SYMBOLS)
        self.symbols: dict[str, object] = {}
        self.known: dict[tuple, tuple[float, tuple]] = {}

    def symbol(self, word: str):
        """What the lexicon transducer writes for a word."""
        if word in self.symbols:
            return self.symbols[word]
        if len(self.symbols) > 50_000:
            self.symbols.clear()
        out = next((self.lexicon[word[:n]] for n in range(min(len(word), self.longest), SHORTEST - 1, -1) if word[:n] in self.lexicon), None) or SEEDS.get(word)
        if out is not None:
            out = (*out, "")
        else:
            out = "target" if word in TARGETS else "negation" if word in NEGATION else "report" if word in REPORT else "quote" if word in QUOTES else "other"
        self.symbols[word] = out
        return out

    def clauses(self, text: str) -> Iterator[tuple[float, tuple]]:
        """Weight and output of the best path of each clause that has a hit."""
        symbol = self.symbol
        for clause in CLAUSE.split(text.lower()):
            read = [symbol(w) for w in TOKEN.findall(clause)]
            if any(type(s) is tuple for s in read):
                yield self.best(read)

    def best(self, read: list) -> tuple[float, tuple]:
        # Of other words only so many matter as a negation reaches.
        key, run = [], 0
        for s in read:
            run = run + 1 if s == "other" else 0
            if run <= SCOPE:
                key.append(s)
        key = tuple(key)
        if key not in self.known:
            if len(self.known) > 4_000:
                self.known.clear()
            self.known[key] = self.fst.best(key)
        return self.known[key]

    def features(self, text: str) -> tuple[float, float]:
        found = [w for w, _ in self.clauses(text) if w > 0]
        return (math.log1p(max(found)), math.log1p(sum(found))) if found else (0.0, 0.0)


# --- learning ------------------------------------------------------------------------------------


def _beginnings(text: str) -> set[str]:
    out = set()
    for word in set(re.findall(r"[^\W\d_]{%d,}" % SHORTEST, text.lower())):
        for n in range(SHORTEST, min(len(word), LONGEST) + 1):
            out.add(word[:n])
    return out


def _counter(wanted: frozenset[str] | None):
    """Counts documents by beginning in each partition; with wanted, only of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["beginning", "docs"])

        for batch in batches:
            for part in arrow_rows(batch, BLOCK):
                for text in text_bytes(part.column("text")):
                    found = _beginnings(text.decode("utf-8", "replace"))
                    held.update(found if wanted is None else found & wanted)
                if len(held) > 200_000:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, text_col: str = "text") -> DataFrame:
    """(text, <label>) of at most ``sample`` labelled documents that are not held out; of rows that repeat
    an id the least text."""
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max(label).alias(label))
    met = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(draw(drawn, "doc_id", sample)), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(label).alias(label)).select("text", label)


def learn_lexicon(sample: DataFrame, chance: float = 0.01) -> dict[str, float]:
    """Beginnings with weights (log odds). What is collected is bounded by the sample."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    count = lambda df, wanted: df.select("text").mapInArrow(tidy(_counter(wanted)), "beginning string, docs long").groupBy("beginning").agg(F.sum("docs").alias("docs"))
    least = 3
    hits = {r["beginning"]: r["docs"] for r in count(sample.where("toxic = 1"), None).where(F.col("docs") >= least).collect()}
    if not hits:
        return {}
    against = {r["beginning"]: r["docs"] for r in count(sample.where("toxic = 0"), frozenset(hits)).collect()}
    prior = toxic / (toxic + clean)
    bound = math.log(len(hits) / chance)
    lexicon: dict[str, float] = {}
    for word in sorted(hits, key=lambda w: (len(w), w)):
        a, b = hits[word], against.get(word, 0)
        q = a / (a + b)
        if q <= prior:
            continue
        kl = q * math.log(q / prior) + ((1 - q) * math.log((1 - q) / (1 - prior)) if q < 1 else 0.0)
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if (a + b) * kl >= bound and odds >= 3.0 and not any(word[:k] in lexicon for k in range(SHORTEST, len(word))):
            lexicon[word] = odds
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 40, nonnegative: bool = False) -> np.ndarray:
    """Newton's method; the first column of the design is 1 and not penalised. nonnegative: a feature whose
    weight would be negative is left out (weight 0) and the rest fitted again."""
    used = list(range(x.shape[1]))
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, used]])
        w = np.zeros(a.shape[1])
        penalty = np.diag([1e-6] + [ridge] * len(used))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        worst = int(w[1:].argmin()) if used else 0
        if not nonnegative or not used or w[1 + worst] >= 0:
            out = np.zeros(1 + x.shape[1])
            out[[0, *(1 + k for k in used)]] = w
            return out
        del used[worst]


DEFAULT_FIT = np.array([-4.0, 2.0, 2.0])


def _marks(lexicon: dict[str, float]):
    """Counts of hits by their marks and the document's label, in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, held = Grammar(lexicon), Counter()
        for batch in batches:
            for part in arrow_rows(batch, BLOCK):
                for text, toxic in zip(text_bytes(part.column("text")), part.column("toxic").to_pylist(), strict=True):
                    for _, out in grammar.clauses(text.decode("utf-8", "replace")):
                        held.update((s[2], toxic) for s in out if type(s) is tuple)
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.string()), pa.array([t for _, t in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["marks", "toxic", "hits"])

    return run


def factors_of(counts: dict[tuple[str, int], int], prior: float = PRIOR) -> dict[str, float]:
    """Each mark's factor from counts of hits by (marks, toxic)."""
    out = {}
    for mark, default in DEFAULTS.items():
        n = {(has, y): sum(c for (m, t), c in counts.items() if (mark in m) == has and t == y) for has in (False, True) for y in (0, 1)}
        plain = (n[False, 1] + 0.5) / (n[False, 1] + n[False, 0] + 1.0)
        share = (n[True, 1] + prior * min(1.0, default * plain)) / (n[True, 1] + n[True, 0] + prior)
        low, high = LIMITS[mark]
        # Among hits that nearly all are toxic a share has no room to rise: the default's rise is kept.
        out[mark] = min(high, max(low, share / plain * (default / min(1.0 / plain, default) if default > 1 else 1.0)))
    return out


def _features(lexicon: dict[str, float], factors: dict[str, float]):
    """A column function of texts: struct(max, sum). Only texts go to Python and only two numbers come back."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar = Grammar(lexicon, factors)
        for texts in columns:
            found = []
            for part in arrow_rows(pa.RecordBatch.from_arrays([texts], names=["text"]), BLOCK):
                found += [grammar.features(x.decode("utf-8", "replace")) for x in text_bytes(part.column("text"))]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)], names=["max", "sum"])

    return F.arrow_udf(tidy(run), "max double, sum double", F.ArrowUDFType.SCALAR_ITER)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], dict[str, float], np.ndarray]:
    """Lexicon, factors and logistic weights."""
    rows = Scratch(docs.sparkSession).write(labelled(docs, labels, "toxic", sample))
    lexicon = learn_lexicon(rows)
    counts = rows.mapInArrow(tidy(_marks(lexicon)), "marks string, toxic int, hits long").groupBy("marks", "toxic").agg(F.sum("hits").alias("hits")).collect()
    factors = factors_of({(r["marks"], r["toxic"]): r["hits"] for r in counts})
    found = rows.select("toxic", _features(lexicon, factors)("text").alias("f")).select("toxic", "f.max", "f.sum").toArrow().to_pandas()
    if found["toxic"].nunique() < 2:
        return lexicon, factors, DEFAULT_FIT
    return lexicon, factors, fit_logistic(found[["max", "sum"]].to_numpy(), found["toxic"].to_numpy(dtype=float), nonnegative=True)  # more evidence never lowers a score


def score(docs: DataFrame, lexicon: dict[str, float], factors: dict[str, float], fit: np.ndarray) -> DataFrame:
    """docs with toxicity__score."""
    cols = docs.columns
    found = docs.withColumn("toxicity__f", _features(lexicon, factors)(F.col("text")))
    z = F.lit(float(fit[0])) + F.lit(float(fit[1])) * F.col("toxicity__f.max") + F.lit(float(fit[2])) * F.col("toxicity__f.sum")
    return found.withColumn("toxicity__score", 1 / (1 + F.exp(-z))).select(*(F.col(f"`{c}`") for c in cols), "toxicity__score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, *model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity__score").alias("score"), (F.col("toxicity__score") >= 0.5).cast("int").alias("predicted"))
