"""Language-model scoring by context-tree weighting over bytes, and a unigram base.

The model predicts each byte of the lower-cased text, and an end mark, from up to DEPTH bytes before
it. A byte is decomposed into eight binary decisions; each decision node has a context tree of its own,
with a Krichevsky-Trofimov estimate (b + 1/2) / (a + b + 1) at every context of every depth. A node's
weighted probability is the even mixture of its estimate and the product of its children's, so the
prediction mixes all depths by how well each has coded the training text. Where a longer context was
never seen in training, the mixture ends at the longest that was.

DEPTH bounds the contexts: five bytes, the longest whose strings of six still pack into one integer
with room to spare; all depths from 0 to it are mixed.

Everything follows from the counts of the strings of DEPTH + 1 bytes in training, over all documents.
They are counted in sorted runs inside the tasks and summed. The trees are built bottom up: depths 5 to
3 in runs of strings that share three bytes of context (a run has one entry per distinct string, however
often it occurs), depth 2 from sums of what these hand up, depths 1 and 0 from at most 65,536 sums.
Probabilities are handed up and added as integers (units of 2^-20 nats, and of 2^-32 digits for scores),
so results are equal bit for bit however the rows are dealt. Strings of documents not trained on are
carried along with count 0, so every string of every document has a probability.

One path serves all sizes: strings and words with a share of 2^-23 and 2^-19 or more of the training
strings and tokens (by that share never more than 2^23 and 2^19 of them) are looked up in broadcast
tables; the others leave a document as one row for each distinct one and are joined, strings and words
in one join.

The base is sum log10((c + 1) / (N + V + 1)) over the tokens. Besides the score the code length per
byte is returned, in bits, over the bytes of the text and its end mark.

Defined results: null text is empty text, one end token; a null id counts by the crc of the empty
text; repeated rows get equal scores each; with no training rows the base is 0 and each bit costs one
bit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, crc_mod, documents, shuffle_partitions, text_bytes, tidy, text_or_empty

DEPTH = 5
MARK = b"\xff"  # never part of UTF-8: stands before and after every text
STRING_SHARE, WORD_SHARE = 1 << 23, 1 << 19
RUN = 1 << 21
PART = 1 << 18  # strings whose trees are built at once, the last three context bytes kept together
NATS, DIGITS = float(1 << 20), float(1 << 32)  # units of the integers that are added
END = b""  # the end token, no word


# --- counts --------------------------------------------------------------------------------------


def strings_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH + 1 bytes up to each position of each marked text, as integers, and how many each has."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    if not texts:
        return np.zeros(0, dtype=np.int64), sizes
    pad = MARK * DEPTH
    buf = np.frombuffer(pad + (MARK + pad).join(texts) + MARK, dtype=np.uint8)
    keys = buf[: len(buf) - DEPTH].astype(np.int64)
    for k in range(1, DEPTH + 1):
        keys <<= 8
        keys |= buf[k : len(buf) - DEPTH + k]
    use = np.ones(len(keys), dtype=bool)
    starts = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    for k in range(DEPTH):
        use[starts + k] = False
    return keys[use], sizes


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of strings and words; rows (string, word, n) with one of the two null."""
    words: Counter = Counter()
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}
    size = 0

    def strings() -> Iterator[pa.RecordBatch]:
        for trained, parts in held.items():
            if parts:
                keys, n = _runs(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.binary()), pa.array(n if trained else n * 0)], names=["string", "word", "n"])
                parts.clear()

    def vocabulary() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["string", "word", "n"])
        words.clear()
        return out

    for batch in batches:
        for part in arrow_rows(batch, 1 << 21):
            texts = [t.lower() for t in text_bytes(part.column("text"))]
            held_out = part.column("held_out").to_pylist()
            for trained in (False, True):
                own = [t for t, h in zip(texts, held_out, strict=True) if h != trained]
                if not own:
                    continue
                keys, _ = strings_of(own)
                held[trained].append(keys)
                size += len(keys)
                if trained:
                    for t in own:
                        words.update(t.split())
                    words[END] += len(own)
            if size > RUN:
                yield from strings()
                size = 0
            if len(words) > 300_000:
                yield vocabulary()
    yield from strings()
    if words:
        yield vocabulary()


# --- trees ---------------------------------------------------------------------------------------

_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: the recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, dtype=np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift[small] += np.log(x[small])
        x[small] += 1
    series = sum(c / x ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def mix_up(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """ln of the even mixture of a node's estimate and its children's product."""
    return np.logaddexp(own, below) - np.log(2)


def keep_own(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Weight of the node's own estimate in its predictions."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Part:
    """Context trees of depths 3 to DEPTH over all strings of some three-byte contexts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n.astype(np.float64)
        self.byte = keys & 255
        self.context = keys >> 8

    def levels(self, k: int):
        """Of the k-th decision: each string's node and bit, by depth the groups of strings at one node
        with their counts, estimates and children, and the depth-3 nodes' strings and probabilities."""
        node = (1 << k) | (self.byte >> (8 - k))
        bit = (self.byte >> (7 - k)) & 1
        out, below = {}, None
        for d in range(DEPTH, 2, -1):
            key = ((self.context & ((1 << (8 * d)) - 1)) << 8) | node
            _, index, group = np.unique(key, return_index=True, return_inverse=True)
            ones = np.bincount(group, weights=self.n * bit)
            zeros = np.bincount(group, weights=self.n * (1 - bit))
            own = log_kt(zeros, ones)
            if below is None:
                children, weighted = None, own
            else:
                children = np.bincount(group[below[0]], weights=below[1], minlength=len(own))
                weighted = mix_up(own, children)
            out[d] = (group, zeros, ones, own, children)
            below = (index, weighted)
        return node, bit, out, below

    def hand_up(self) -> pd.DataFrame:
        """(context, node, zeros, ones, weighted) of the depth-3 nodes."""
        frames = []
        for k in range(8):
            node, _, levels, (index, weighted) = self.levels(k)
            _, zeros, ones, _, _ = levels[3]
            frames.append(pd.DataFrame({"context": self.context[index] & 0xFFFFFF, "node": node[index], "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "weighted": np.rint(weighted * NATS).astype(np.int64)}))
        return pd.concat(frames)

    def log10_p(self, above: pd.DataFrame, top: "Top") -> np.ndarray:
        """log10 of the probability of each string's last byte after the bytes before it; above: for
        each depth-3 (context, node) the counts and the weight of the depth-2 node above it."""
        total = np.zeros(len(self.keys))
        last = self.context & 255
        code = (above["context"].to_numpy(dtype=np.int64) << 8) | above["node"].to_numpy(dtype=np.int64)
        order = np.argsort(code)
        code, zeros2, ones2, keep2 = code[order], *(above[c].to_numpy(dtype=np.float64)[order] for c in ("zeros", "ones", "keep"))
        for k in range(8):
            node, bit, levels, _ = self.levels(k)
            p, seen = np.full(len(self.keys), 0.5), np.zeros(len(self.keys), dtype=bool)
            at = np.searchsorted(code, ((self.context & 0xFFFFFF) << 8) | node)
            for d in range(DEPTH, -1, -1):
                if d >= 3:
                    group, zeros, ones, own, children = levels[d]
                    count, estimate = (zeros + ones)[group], ((ones + 0.5) / (zeros + ones + 1))[group]
                    weight = keep_own(own, children)[group] if children is not None else 1.0
                elif d == 2:
                    count = (zeros2 + ones2)[at]
                    estimate, weight = (ones2[at] + 0.5) / (count + 1), keep2[at]
                elif d == 1:
                    count, estimate, weight = top.count1[last, node], top.kt1[last, node], top.weight1[last, node]
                else:
                    count, estimate, weight = top.count0[node], top.kt0[node], top.weight0[node]
                here = count > 0
                p = np.where(here, np.where(seen, weight * estimate + (1 - weight) * p, estimate), p)
                seen = here
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


class Top:
    """Depths 1 and 0 of all trees: at most 256 x 256 nodes."""

    def __init__(self, sums: pd.DataFrame):
        zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
        at = sums["last"].to_numpy(dtype=np.int64), sums["node"].to_numpy(dtype=np.int64)
        zeros[at], ones[at], below[at] = sums["zeros"], sums["ones"], sums["weighted"] / NATS
        own = log_kt(zeros, ones)
        self.count1, self.kt1, self.weight1 = zeros + ones, (ones + 0.5) / (zeros + ones + 1), keep_own(own, below)
        below, zeros, ones = mix_up(own, below).sum(axis=0), zeros.sum(axis=0), ones.sum(axis=0)
        self.count0, self.kt0, self.weight0 = zeros + ones, (ones + 0.5) / (zeros + ones + 1), keep_own(log_kt(zeros, ones), below)


def _whole_contexts(frames: Iterator[pd.DataFrame], part: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by context, regrouped into frames of about ``part`` rows that cut no context."""
    held: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        size += len(f)
        if size < part:
            continue
        whole = pd.concat(held)
        cut = int(np.searchsorted(whole["context"].to_numpy(), whole["context"].iloc[-1]))
        if cut:
            yield whole.iloc[:cut]
        held, size = [whole.iloc[cut:]], len(whole) - cut
    if size:
        yield pd.concat(held)


def _second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depth-2 nodes from their summed children: what they hand up, and the weight of their own estimate."""
    for f in frames:
        own, below = log_kt(f["zeros"].to_numpy(dtype=np.float64), f["ones"].to_numpy(dtype=np.float64)), f["weighted"].to_numpy() / NATS
        yield f.assign(weighted=np.rint(mix_up(own, below) * NATS).astype(np.int64), keep=keep_own(own, below))


def build(strings: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """(string, n, log10_p) of strings(string, n), the probabilities in units of 1 / DIGITS."""
    spark = strings.sparkSession
    keyed = strings.select(F.shiftright("string", 8).bitwiseAND(0xFFFFFF).alias("context"), "string", "n")
    dealt = lambda df: df.repartition(shuffle_partitions(spark), "context").sortWithinPartitions("context")

    def up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_contexts(frames, part):
            yield Part(f["string"].to_numpy(dtype=np.int64), f["n"].to_numpy()).hand_up()

    third = scratch.write(dealt(keyed).mapInPandas(tidy(up), "context long, node long, zeros long, ones long, weighted long"))
    summed = lambda df, by: df.groupBy(by, "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")))
    second = summed(third.withColumn("pair", F.col("context").bitwiseAND(0xFFFF)), "pair")
    second = scratch.write(second.mapInPandas(_second, "pair long, node long, zeros long, ones long, weighted long, keep double"))
    top = spark.sparkContext.broadcast(Top(summed(second.withColumn("last", F.col("pair").bitwiseAND(0xFF)), "last").toArrow().to_pandas()))
    above = third.select("context", "node", F.col("context").bitwiseAND(0xFFFF).alias("pair")).join(second.select("pair", "node", "zeros", "ones", "keep"), ["pair", "node"])

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_contexts(frames, part):
            own = f["string"].notna().to_numpy()
            if own.any():
                mine = Part(f["string"].to_numpy(dtype=np.float64, na_value=np.nan)[own].astype(np.int64), f["n"].to_numpy()[own])
                yield pd.DataFrame({"string": mine.keys, "n": mine.n.astype(np.int64), "log10_p": np.rint(mine.log10_p(f[~own], top.value) * DIGITS).astype(np.int64)})

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = keyed.select("context", "string", "n", none("long", "node"), none("long", "zeros"), none("long", "ones"), none("double", "keep"))
    both = both.unionByName(above.select("context", none("long", "string"), F.lit(0).cast("long").alias("n"), "node", "zeros", "ones", "keep"))
    return dealt(both).mapInPandas(tidy(predict), "string long, n long, log10_p long")


# --- scores --------------------------------------------------------------------------------------


class Table:
    """Integers by 48-bit key: open addressing in flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys) // 3).bit_length())  # three quarters full at most
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), dtype=bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, 0 where it has none, and the places of the keys without."""
        at = self._slot(keys)
        out, held = self.values[at], self.keys[at]
        out[held != keys] = 0
        look, lost = np.flatnonzero((held != keys) & (held >= 0)), [np.flatnonzero(held < 0)]
        while len(look):
            at[look] = (at[look] + 1) & (len(self.keys) - 1)
            held = self.keys[at[look]]
            met = held == keys[look]
            out[look[met]] = self.values[at[look[met]]]
            lost.append(look[held < 0])
            look = look[~met & (held >= 0)]
        return out, np.sort(np.concatenate(lost))


_TABLES: dict[str, Table] = {}


def _table(name: str, held) -> Table:
    """The table of a broadcast, built once in each worker."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Table(*held.value)
    return _TABLES[name]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, all above 0."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, dtype=np.int64)


#: Keys of the one join: words as they are, strings and a document's own row behind bytes that no UTF-8 has.
_STRING, _OWN = b"\xfe", b"\xff"
_STATS = pa.struct([(c, pa.int64()) for c in ("n_tokens", "n_known", "n_bytes", "base", "score")])
_FLAT = "doc_id long, h long, key binary, times int, stats struct<n_tokens:long,n_known:long,n_bytes:long,base:long,score:long>"


def _string_keys(strings: np.ndarray) -> pa.Array:
    data = np.empty((len(strings), 7), dtype=np.uint8)
    data[:, 0] = _STRING[0]
    data[:, 1:] = strings.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return pa.Array.from_buffers(pa.binary(), len(strings), [None, pa.py_buffer(np.arange(0, 7 * len(strings) + 1, 7, dtype=np.int32)), pa.py_buffer(data.tobytes())])


def _scorer(frequent, table, name: str):
    """Per document a row with its statistics, a row for each distinct word (times above 0) and for each
    distinct string (below 0) outside the broadcast tables. A document's row has a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, tree = frequent.value.get, _table(name, table)
        names = ["doc_id", "h", "key", "times", "stats"]
        for batch in batches:
            for part in arrow_rows(batch, 1 << 21):
                texts = [t.lower() for t in text_bytes(part.column("text"))]
                words: list[bytes] = []
                counts = []
                for t in texts:
                    own = t.split()
                    own.append(END)
                    words += own
                    counts.append(len(own))
                values = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                rare = values < 0
                sizes = np.array(counts, dtype=np.int64)
                base = _sums(np.where(rare, 0, values), sizes)
                known = _sums((~rare).astype(np.int64), sizes)
                keys, lens = strings_of(texts)
                found, lost = tree.find(keys)
                ids, h = part.column("doc_id"), part.column("h")
                stats = pa.StructArray.from_arrays([pa.array(x) for x in (sizes, known, lens, base, _sums(found, lens))], fields=list(_STATS))
                yield pa.RecordBatch.from_arrays([ids, h, pa.array([_OWN + str(x).encode() for x in h.to_pylist()], pa.binary()), pa.array(np.zeros(len(texts), dtype=np.int32)), stats], names=names)
                owner = np.repeat(np.arange(len(texts)), sizes)
                pairs = Counter(zip(owner[rare].tolist(), (words[i] for i in np.flatnonzero(rare)), strict=True))
                if pairs:
                    at = pa.array([i for i, _ in pairs])
                    yield pa.RecordBatch.from_arrays([ids.take(at), h.take(at), pa.array([w for _, w in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int32()), pa.nulls(len(pairs), _STATS)], names=names)
                if len(lost):
                    owner = np.searchsorted(np.cumsum(lens), lost, side="right")
                    order = np.lexsort((keys[lost], owner))
                    owner, strings = owner[order], keys[lost][order]
                    first = np.flatnonzero(np.concatenate(([True], (strings[1:] != strings[:-1]) | (owner[1:] != owner[:-1]))))
                    times, at = -np.diff(np.append(first, len(strings))), pa.array(owner[first])
                    yield pa.RecordBatch.from_arrays([ids.take(at), h.take(at), _string_keys(strings[first]), pa.array(times.astype(np.int32)), pa.nulls(len(first), _STATS)], names=names)

    return run


def score(df: DataFrame, held_out: str = "held_out", string_share: int = STRING_SHARE, word_share: int = WORD_SHARE, part: int = PART) -> DataFrame:
    """df(doc_id, text, held_out): doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.select("doc_id", text_or_empty("text").alias("text"), F.col(held_out).alias("held_out"))
    counts = rows.select("text", "held_out").mapInArrow(tidy(_count), "string long, word binary, n long").groupBy("string", "word").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts)
    total = counts.groupBy(F.col("word").isNotNull().alias("words")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    (n_words, v_words), n_strings = next(((r["n"], r["v"]) for r in total if r["words"]), (0, 0)), next((r["n"] for r in total if not r["words"]), 0)
    often = lambda n, share: -(-max(1, n) // share)
    words = counts.where("word is not null").select(F.col("word").alias("key"), "n", F.rint(F.log10(F.col("n") + 1.0) * DIGITS).cast("long").alias("v"))
    many = F.col("n") >= often(n_words, word_share)
    held = words.where(many).select("key", "v").toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(held["key"].to_pylist(), held["v"].to_pylist(), strict=True)))
    model = scratch.write(build(counts.where("string is not null"), scratch, part))
    common = F.col("n") >= often(n_strings, string_share)
    held = model.where(common).select("string", "log10_p").toArrow()
    table = spark.sparkContext.broadcast((held["string"].to_numpy(), held["log10_p"].to_numpy()))
    del held
    rare = model.where(~common).select(F.unhex(F.concat(F.lit(_STRING.hex()), F.lpad(F.hex("string"), 12, "0"))).alias("key"), F.col("log10_p").alias("v")).unionByName(words.where(~many).select("key", "v"))
    flat = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(tidy(_scorer(frequent, table, scratch.root)), _FLAT)
    met = flat.join(rare, "key", "left")
    add = lambda name, when, c: (F.coalesce(F.sum(f"stats.{name}"), F.lit(0)) + F.coalesce(F.sum(F.when(F.expr(when), c)), F.lit(0))).alias(name)
    none = F.lit(None).cast("long")
    found = met.groupBy("doc_id", "h").agg(
        F.count("stats").alias("copies"), add("n_tokens", "false", none), add("n_bytes", "false", none), add("n_known", "times > 0 and v is not null", F.col("times")),
        add("base", "times > 0", F.col("times") * F.col("v")), add("score", "times < 0", -F.col("times") * F.col("v")),
    )
    # Rows that repeat an id and text were summed together: divide, and give each its row again.
    k = F.col("copies")
    found = found.select("doc_id", *((F.expr(f"{c} div copies")).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base", "score")), F.explode(F.sequence(F.lit(1).cast("long"), k)).alias("copy"))
    digits = F.lit(float(np.log10(max(1, n_words + v_words + 1))))
    score = F.col("score") / DIGITS
    return found.select("doc_id", "n_tokens", "n_known", F.lit(int(n_words)).cast("long").alias("train_tokens"), (F.col("base") / DIGITS - F.col("n_tokens") * digits).alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score(docs).select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
