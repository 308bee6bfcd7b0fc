"""N-gram Jaccard join by prefix trees.

Documents become sets of word shingles (64-bit hashes). Equal sets form classes; only one of each is
joined. All sets are written in one global order, rare shingles first. Two sets with Jaccard t share a
shingle within their first |s| - ceil(t |s|) + 1, so those are posted. Of the sets under one shingle, those
stay that have a mate there whose size (told first, before anything else is shipped) and signature
(parities of the shingles, which bound from below in how many two sets differ) allow a link; each chain
of mates meets at its *leader*, the least of them, so sets that share many shingles meet once instead
of once for each. There the sets are stored in a trie by their global order, and each set is matched by one traversal: the partial overlap is carried down a
path and shared by all sets below it, and a subtree is left as soon as the shingles remaining on
either side cannot reach the overlap asked for. Sets that are already connected below a leader are not
matched again, which leaves the components as they are. Links are exact.

The order is a hint that cannot change the result, only its cost: all shingles are counted, those
with a share of 2^-18 or more of the counts (so at most 2^18, 4 MB, broadcast) come last by their count, all others are rare and go
by hash. A shingle or leader with more than ``GROUP`` sets is dealt in blocks to several tasks. Which sets are met
at all is told by a bitmap of at most 2^27 bits, so only those are read again. Links are gathered as
pairs of classes; components come from ``common.components``.

Defined results: null text, or text without words, is the empty set and linked with nothing; fewer
words than the width are one shingle; a null id takes part but never names a component that has
others; repeated rows are in one class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, components, documents, mix64, shingle_sets, shuffle_partitions, text_bytes, tidy

FREQUENT = 1 << 18
CHUNK = 1 << 22
#: A shingle counts as frequent from this many documents in a chunk on.
LOCAL = 8
#: Sets of one leader that one task joins.
GROUP = 8192


def prefix_length(n: int, num: int, den: int) -> int:
    """A partner has at least ceil(t n) of the n shingles, so one of the first n - ceil(t n) + 1."""
    return n - -(-num * n // den) + 1


def set_id(s: np.ndarray) -> int:
    """A 63-bit name of a set, never 0."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big") >> 1 or 1


def in_order(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in global order: rare by hash, then frequent by count and hash."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    rank = np.where(frequent[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))]


_IDS = "sid long, n long, sig binary, shingle long, docs long"


def signature(s: np.ndarray) -> bytes:
    """Parities of the set's shingles over 512 bits or, for larger sets, 4, 16 or 64 times as many. Two
    sets' signatures, folded to the same length, differ in no more bits than the sets in shingles."""
    bits = 512
    while len(s) > bits * 3 // 2 and bits < 32768:
        bits *= 4
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sig: bytes, size: int) -> np.ndarray:
    """The signature folded to size bytes, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, dtype=np.uint64).reshape(-1, size // 8), axis=0)


def most_apart(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many shingles sets of a and b elements may differ."""
    return a + b - 2 * -(-num * (a + b) // (num + den))


def _mates(shingles: np.ndarray, sids: np.ndarray, n: np.ndarray, sigs: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by their groups in; out (leader, sid) of the sets that have a mate in their group whose
    size and signature allow a link. The leader is the least set that a chain of mates reaches."""
    k = len(sids)
    small = np.stack([fold(x, 64) for x in sigs])
    head = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
    size = np.diff(np.append(head, k))
    parent = np.arange(k)
    met = np.zeros(k, dtype=bool)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def check(a: np.ndarray, b: np.ndarray) -> None:
        fits = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (sids[a] != sids[b])
        a, b = a[fits], b[fits]
        apart = np.bitwise_count(small[a] ^ small[b]).sum(axis=1)
        near = apart <= most_apart(n[a], n[b], num, den)
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            short = min(len(sigs[i]), len(sigs[j]))
            if short > 64 and int(np.bitwise_count(fold(sigs[i], short) ^ fold(sigs[j], short)).sum()) > most_apart(n[i], n[j], num, den):
                continue
            met[i] = met[j] = True
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)

    group = np.repeat(size, size)
    for lag in range(1, min(int(size.max()), 64)):
        a = np.flatnonzero((shingles[:-lag] == shingles[lag:]) & (group[lag:] <= 64))
        check(a, a + lag)
    for g in np.flatnonzero(size > 64).tolist():
        rows = np.arange(head[g], head[g] + size[g])
        rows = rows[np.argsort(n[rows], kind="stable")]
        for k2, i in enumerate(rows[:-1].tolist()):
            b = rows[k2 + 1 :]
            b = b[: int(np.searchsorted(n[b], n[i] * den // num, side="right"))]
            check(np.full(len(b), i), b)
    roots = np.array([find(i) for i in np.flatnonzero(met).tolist()], dtype=np.int64)
    return sids[roots] if len(roots) else sids[:0], sids[met]


def _mate_finder(num: int, den: int):
    """(leader, sid) over a partition's whole groups of (shingle, i, j), which are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key = mix64(mix64(t["shingle"].to_numpy().view(np.uint64)) + (t["i"].to_numpy().astype(np.uint64) << np.uint64(32)) + t["j"].to_numpy().astype(np.uint64))
        order = np.lexsort((t["sid"].to_numpy(), key))
        sigs = t["sig"].to_pylist()
        leader, sid = _mates(key[order], t["sid"].to_numpy()[order], t["n"].to_numpy()[order], [sigs[i] for i in order], num, den)
        if len(sid):
            pairs = np.unique(np.stack([leader, sid], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["leader", "sid"])

    return run


def _id_sets(width: int, id_col: str):
    """One row a document (id, set id or 0 if empty, size), and rows (shingle, docs) of partial counts of
    the shingles met LOCAL times or more among about CHUNK shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        kind = None

        def flush() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            docs = np.diff(np.append(first, len(s)))
            many = docs >= LOCAL
            k = int(many.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(s[first[many]].view(np.int64)), pa.array(docs[many])], names=[id_col, "sid", "n", "sig", "shingle", "docs"])

        for batch in batches:
            kind = batch.column(id_col).type
            for part in arrow_rows(batch, CHUNK):
                sets = shingle_sets(text_bytes(part.column("text")), width)
                k = len(sets)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([set_id(s) if len(s) else 0 for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=[id_col, "sid", "n", "sig", "shingle", "docs"])
                held.extend(sets)
                size += sum(map(len, sets))
                if size > CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _postings(width: int, num: int, den: int, order):
    """Each set's shingles of its prefix: (shingle, sid, n). Copies read by one task post once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = order.value
        seen: set[int] = set()
        for batch in batches:
            for part in arrow_rows(batch, CHUNK):
                shingles, sids, sizes = [], [], []
                for s in shingle_sets(text_bytes(part.column("text")), width):
                    if not len(s) or (sid := set_id(s)) in seen:
                        continue
                    seen.add(sid)
                    shingles.append(in_order(s, frequent, counts)[: prefix_length(len(s), num, den)])
                    sids.append(sid)
                    sizes.append(len(s))
                if shingles:
                    each = [len(p) for p in shingles]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.repeat(np.array(sids, dtype=np.int64), each)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), each))], names=["shingle", "sid", "n"])

    return run


def _sized(num: int, den: int):
    """Of rows sorted by shingle, n and sid, those with a neighbour under the same shingle whose size
    allows a link. If any set's size does, a neighbour's in this order does. One row is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last row, and whether the row before it fits it
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("shingle", "sid", "n")]
            if not len(rows[0]):
                continue
            fits_before = False
            if carry is not None:
                rows = [np.concatenate(([c], r)) for c, r in zip(carry[0], rows, strict=True)]
                fits_before = carry[1]
            shingle, sid, n = rows
            new = np.concatenate(([True], (sid[1:] != sid[:-1]) | (shingle[1:] != shingle[:-1])))
            shingle, sid, n = shingle[new], sid[new], n[new].astype(np.int64)
            fits = (shingle[1:] == shingle[:-1]) & (den * n[:-1] >= num * n[1:])
            before = np.concatenate(([fits_before], fits))
            keep = before[:-1] | fits
            carry = ((shingle[-1], sid[-1], n[-1]), bool(before[-1]))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(shingle[:-1][keep]), pa.array(sid[:-1][keep])], names=["shingle", "sid"])
        if carry is not None and carry[1]:
            yield pa.RecordBatch.from_arrays([pa.array([carry[0][0]], pa.int64()), pa.array([carry[0][1]], pa.int64())], names=["shingle", "sid"])

    return run


def _active_sets(width: int, bitmap):
    """(sid, sorted shingles) of the sets whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        seen: set[int] = set()
        for batch in batches:
            for part in arrow_rows(batch, CHUNK):
                sids, sets = [], []
                for s in shingle_sets(text_bytes(part.column("text")), width):
                    if not len(s) or (sid := set_id(s)) in seen:
                        continue
                    at = sid % (len(bits) * 64)
                    if int(bits[at // 64]) >> (at % 64) & 1:
                        seen.add(sid)
                        sids.append(sid)
                        sets.append(s.tobytes())
                if sids:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return run


class Trie:
    """A compressed trie of sets of ranks, laid flat: each node has a run of ranks, its parent, the
    least and greatest size of the sets below it, and the set that ends in it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        parent, end, source, name = [-1], [0], [order[0]], [-1]
        stack = [0]
        before = None
        for i in order:
            s, shared = sets[i], 0
            if before is not None:
                m = min(len(s), len(before))
                differ = np.flatnonzero(s[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            below = -1
            while end[stack[-1]] > shared:
                below = stack.pop()
            if end[stack[-1]] < shared:  # the path divides inside a run: its first part becomes a node
                parent.append(stack[-1])
                end.append(shared)
                source.append(source[below])
                name.append(-1)
                parent[below] = len(parent) - 1
                stack.append(len(parent) - 1)
            parent.append(stack[-1])
            end.append(len(s))
            source.append(i)
            name.append(i)
            stack.append(len(parent) - 1)
            before = s
        self.parent, self.end, self.name = np.array(parent), np.array(end), np.array(name)
        n = len(parent)
        start = np.where(self.parent >= 0, self.end[self.parent], 0)
        self.off = np.concatenate(([0], np.cumsum(self.end - start)))
        self.runs = np.concatenate([sets[k][a:b] for k, a, b in zip(source, start.tolist(), end, strict=True)])
        self.last = np.array([int(sets[k][b - 1]) if b else -1 for k, b in zip(source, end, strict=True)])
        self.low, self.high = np.full(n, 1 << 60), np.zeros(n, dtype=np.int64)
        for node, i in enumerate(name):
            while i >= 0 and node >= 0:
                size = len(sets[i])
                if self.low[node] <= size <= self.high[node]:
                    break
                self.low[node], self.high[node] = min(self.low[node], size), max(self.high[node], size)
                node = parent[node]
        by_parent = np.argsort(self.parent, kind="stable")
        counts = np.bincount(self.parent[1:], minlength=n) if n > 1 else np.zeros(n, dtype=np.int64)
        self.children, self.first = by_parent[1:], np.concatenate(([0], np.cumsum(counts)))

    def search(self, ranks: np.ndarray, universe: int, num: int, den: int) -> np.ndarray:
        """Names of the sets with Jaccard num / den or more, all paths advanced together level by level."""
        n = len(ranks)
        has = np.zeros(universe, dtype=np.int64)
        has[ranks] = 1
        nodes, overlap, found = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
        while len(nodes):
            a, b = self.first[nodes], self.first[nodes + 1]
            at = _ranges(a, b)
            up = np.repeat(np.arange(len(nodes)), b - a)
            nodes, overlap = self.children[at], overlap[up]
            fits = (den * n >= num * self.low[nodes]) & (den * self.high[nodes] >= num * n)
            nodes, overlap = nodes[fits], overlap[fits]
            a, b = self.off[nodes], self.off[nodes + 1]
            sums = np.concatenate(([0], np.cumsum(has[self.runs[_ranges(a, b)]])))
            cut = np.concatenate(([0], np.cumsum(b - a)))
            overlap = overlap + sums[cut[1:]] - sums[cut[:-1]]
            name = self.name[nodes]
            full = (name >= 0) & ((num + den) * overlap >= num * (n + self.end[nodes]))
            found.append(name[full])
            left = n - np.searchsorted(ranks, self.last[nodes], side="right")
            most = overlap + np.minimum(left, self.high[nodes] - self.end[nodes])
            alive = (num + den) * most >= num * (n + self.low[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
        return np.concatenate(found)


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0]..b[0]-1, a[1]..b[1]-1 and so on, one after another."""
    size = b - a
    shift = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])) if len(a) else a, size)
    return np.arange(len(shift)) + shift


def join_group(sets: list[np.ndarray], num: int, den: int, frequent: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Links between the sets (by position) that connect all pairs with Jaccard num / den or more."""
    values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.empty(len(values), dtype=np.int64)
    place[np.searchsorted(values, in_order(values, frequent, counts))] = np.arange(len(values))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(r) for r in np.split(place[ranks], cuts)]
    trie = Trie(ranked)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(sets)):
        mine = find(i)
        for j in trie.search(ranked[i], len(values), num, den).tolist():
            if (other := find(j)) != mine:
                links.append((i, j))
                parent[other] = mine
    return links


def _joiner(num: int, den: int, order):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("sid")
        if len(frame) < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        sids = frame["sid"].to_numpy()
        links = join_group([np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]], num, den, *order.value)
        return pd.DataFrame({"a": [int(sids[i]) for i, _ in links], "b": [int(sids[j]) for _, j in links]}).astype("int64")

    return run


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, sid, blocks) dealt to blocks (key, i, j) so that every two of a key's sets meet in one:
    a set goes to as many as its key has blocks, almost always one."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(key, "sid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row a document: id, n_shingles, class (its set's name, 0 if empty) and component_id."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    both = scratch.write(df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(tidy(_id_sets(width, id_col)), f"`{id_col}` {kind}, {_IDS}"))
    ids = both.where("sid is not null").select(id_col, "sid", "n", "sig")
    counted = both.where("shingle is not null").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    # Shingles with a share of 1 / FREQUENT of all counts or more: at most FREQUENT of them, without any ordering.
    least = -(-(both.agg(F.sum("docs")).first()[0] or 0) // FREQUENT)
    top = counted.where(F.col("docs") >= least).toArrow().to_pandas()
    frequent = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    by_value = np.argsort(frequent)
    order = spark.sparkContext.broadcast((frequent[by_value], top["docs"].to_numpy(dtype=np.int64)[by_value]))

    postings = texts.mapInArrow(tidy(_postings(width, num, den, order)), "shingle long, sid long, n int")
    sorted_postings = postings.repartition(shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle", "n", "sid")
    sized = scratch.write(sorted_postings.mapInArrow(tidy(_sized(num, den)), "shingle long, sid long"))
    blocks = F.ceil(F.count("*") / F.lit(float(GROUP))).cast("int")
    hot = sized.groupBy("shingle").agg(blocks.alias("blocks")).where("blocks > 1")
    classes = ids.where("sid <> 0").groupBy("sid").agg(F.min(id_col).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    asked = _dealt(sized.join(hot, "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "shingle").join(classes.drop("rep"), "sid")
    mates = asked.repartition(shuffle_partitions(spark), "shingle", "i", "j").select("shingle", "i", "j", "sid", "n", "sig").mapInArrow(tidy(_mate_finder(num, den)), "leader long, sid long")
    met = scratch.write(mates.distinct())
    scratch.drop(sized)

    words = 1 << max(10, min(21, (max(1, ids.count()) * 8 // 64).bit_length()))
    bit = F.pmod(F.col("sid"), F.lit(words * 64))
    rows = met.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(sid, {words * 64}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()
    bits = np.zeros(words, dtype=np.uint64)
    bits[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    bitmap = spark.sparkContext.broadcast(bits)
    sets = texts.mapInArrow(tidy(_active_sets(width, bitmap)), "sid long, shingles binary").dropDuplicates(["sid"])
    sizes = met.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(float(GROUP))).cast("int").alias("blocks"))
    dealt = _dealt(met.join(sizes, "leader"), "leader")
    links = dealt.join(sets, "sid").groupBy("leader", "i", "j").applyInPandas(_joiner(num, den, order), "a long, b long")
    comps = components(spark, links, scratch)
    scratch.drop(met)

    classes = classes.select("sid", "rep")
    named = comps.join(classes, comps.node == classes.sid).select("sid", "comp", "rep")
    best = named.groupBy("comp").agg(F.min("rep").alias("best"))
    linked = named.join(best, "comp").select("sid", "best")
    # A written table: the join below may then split the rows of a hot class, whose own row is one.
    of_class = scratch.write(classes.join(linked, "sid", "left").select("sid", F.coalesce("best", "rep").alias("component_id")))
    out = ids.join(of_class, "sid", "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.col("sid").alias("class"), F.coalesce("component_id", id_col).alias("component_id"))


def keep_one(df: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """df with one document of each component: the one with the least id, once. Rows without an id stay."""
    found = Scratch(df.sparkSession).write(join(df, width=width, num=num, den=den))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    out = df.join(gone, "doc_id", "left_anti").select(df.columns)
    twice = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if twice.isEmpty():
        return out
    return out.join(twice, "doc_id", "left_anti").select(df.columns).unionByName(out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, counted: right where the table is small.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * c >= 90 * (na.n_shingles + nb.n_shingles - c)),
e AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, any_value(n_shingles) AS n_shingles, min(r.other)::BIGINT AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
"""
