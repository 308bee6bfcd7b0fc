"""Ranked lexical search: document-at-a-time merge of compressed postings, shard by shard.

Index: each task turns its documents into segments (shards of at most ``DOCS`` documents or ``BYTES`` of
text; a longer text stands alone), one row each. In a segment documents are numbered by ascending id, and
a term's postings are blocks of ``BLOCK``: gaps between document numbers and occurrences, each in as few
bytes as the block's largest needs, with a head that states first document, most occurrences and least
length. Texts are read once and never shuffled; segments go to the shared folder.

Search: for each item a heap of its terms' cursors, keyed by each one's next document. The merge takes
all postings of the next ``SPAN`` documents from the cursors that the heap gives, so that these documents
are scored as a whole, in order of their numbers, before any later one; what reaches the score of the
item's k-th best so far enters its result heap (k entries, by score, then id). A result heap lives
through all segments of a task: a segment whose heads promise less than its k-th score is left out. The
heaps of all tasks are merged by item.

Bounds: items are dealt to blocks of about ``WORDS`` words; each block is one broadcast and one pass over
the index, none over the texts. Where all items have at most ``VOCABULARY`` words, the index holds their
terms only; beyond that it holds all terms. Results are equal.

Defined results: documents without terms count for nothing; each row is a document, repeated ids too, and
rows without an id come after all ids of equal score; each row of the items is an item, and items without
terms give no rows; terms found in no document add nothing; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import Scratch, arrow_rows, documents, lower_ascii, text_bytes, tidy
from .op11_decontaminate import LOWERED, words_of

DOCS, BYTES = 16_384, 1 << 25
BLOCK, SPAN = 128, 1024
WORDS, VOCABULARY = 1 << 18, 1 << 20
TOP = 10
K1_SCALE, M_SCALE, FULL = 1000, 8, 1_000_000_000

_SEGMENT = (
    "n_docs long, n_words long, lens array<long>, terms array<string>, df array<long>, "
    "heads struct<at: array<long>, size: array<long>, first: array<long>, most: array<long>, least: array<long>, gap_bytes: array<long>, tf_bytes: array<long>>, postings binary"
)


def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


class Builder:
    """Takes documents and gives them back as one segment."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list = []
        self.lens: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, text: bytes, vocabulary: frozenset[bytes] | None) -> None:
        held: Counter[bytes] = Counter()
        n = 0
        for words in words_of(text):
            held.update(words)
            n += len(words)
        if not n:
            return
        kept = list(held) if vocabulary is None else list(held.keys() & vocabulary)
        self.ids.append(doc_id)
        self.lens.append(n)
        self.terms.append(np.array([self.number.setdefault(w, len(self.number)) for w in kept], dtype=np.int64))
        self.tfs.append(np.array([held[w] for w in kept], dtype=np.int64))
        self.bytes += len(text)

    def segment(self, kind: pa.DataType) -> dict:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] if self.ids[k] is not None else 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        lens = np.array(self.lens, dtype=np.int64)[order]
        doc = np.repeat(place, [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        df = np.bincount(term, minlength=len(self.number))
        start = np.cumsum(df) - df
        blocks = -(-df // BLOCK)
        owner = np.repeat(np.arange(len(df)), blocks)
        at = start[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        end = np.minimum(at + BLOCK, (start + df)[owner])
        heads: dict[str, np.ndarray] = {"size": end - at, "first": doc[at]}
        gaps = np.diff(doc, prepend=0)
        gaps[at] = 0  # a block starts from its head
        reduce = lambda f, x: f.reduceat(x, at) if len(at) else at
        heads |= {"most": reduce(np.maximum, tf), "least": reduce(np.minimum, lens[doc])}
        heads |= {"gap_bytes": _width(reduce(np.maximum, gaps)), "tf_bytes": _width(heads["most"])}
        out = bytearray()
        places = []
        for a, b, g, t in zip(at.tolist(), end.tolist(), heads["gap_bytes"].tolist(), heads["tf_bytes"].tolist(), strict=True):
            places.append(len(out))
            out += gaps[a:b].astype(f"<u{g}").tobytes() + tf[a:b].astype(f"<u{t}").tobytes()
        return {
            "docs": pa.array([[self.ids[k] for k in order]], pa.list_(kind)), "n_docs": len(order), "n_words": int(lens.sum()), "lens": lens, "terms": [w.decode("utf-8", "replace") for w in self.number], "df": df,
            "heads": {"at": places} | heads, "postings": bytes(out),
        }


def _indexer(vocabulary, id_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        held = Builder()
        kind = schema.field("docs").type.value_type

        def flush() -> pa.RecordBatch:
            row = held.segment(kind)
            return pa.RecordBatch.from_arrays([row[f.name] if f.name == "docs" else pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for part in arrow_rows(batch, 1 << 21):
                for doc_id, text in zip(part.column(id_col).to_pylist(), text_bytes(part.column("text")), strict=True):
                    if held.ids and (len(held.ids) == DOCS or held.bytes + len(text) > BYTES):
                        yield flush()
                        held = Builder()
                    held.add(doc_id, text, known)
        if held.ids:
            yield flush()

    return run


def build_index(docs: DataFrame, id_col: str, text_col: str, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """Segments of all documents that have a term: all terms, or those of the vocabulary."""
    schema = T.StructType.fromDDL(_SEGMENT).add("docs", T.ArrayType(docs.schema[id_col].dataType))
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_indexer(known, "id", to_arrow_schema(schema))), schema)


def norm(lens: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of so many terms."""
    if 75 * int(lens.max(initial=0)) * n_docs < 1 << 63:
        return 25 + 75 * lens * n_docs // n_words
    return np.array([25 + 75 * n * n_docs // n_words for n in lens.tolist()], dtype=np.int64)  # 64 bits hold the quotient, not the product


def factor(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return FULL * tf // (K1_SCALE * tf + M_SCALE * m)


class Segment:
    """A segment's row, its blocks decoded as they are first asked for."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.docs = row["docs"]
        self.m = norm(np.asarray(row["lens"], dtype=np.int64), n_docs, n_words)
        df = np.asarray(row["df"], dtype=np.int64)
        blocks = -(-df // BLOCK)
        self.start = np.concatenate([[0], np.cumsum(blocks)])
        self.place = {t: k for k, t in enumerate(row["terms"])}
        self.heads = {k: np.asarray(v, dtype=np.int64) for k, v in row["heads"].items()}
        self.first = self.heads["first"].tolist()
        most = self.heads["most"]
        best = factor(most, norm(self.heads["least"], n_docs, n_words))
        self.best = np.maximum.reduceat(best, self.start[:-1]) if len(best) else best
        self.postings = row["postings"]
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers of a block and the factor of each."""
        if b not in self.decoded:
            h = {k: int(v[b]) for k, v in self.heads.items()}
            gaps = np.frombuffer(self.postings, f"<u{h['gap_bytes']}", h["size"], h["at"])
            tf = np.frombuffer(self.postings, f"<u{h['tf_bytes']}", h["size"], h["at"] + h["size"] * h["gap_bytes"]).astype(np.int64)
            doc = h["first"] + np.cumsum(gaps, dtype=np.int64)
            self.decoded[b] = doc, factor(tf, self.m[doc])
        return self.decoded[b]


class Cursor:
    """Walks over a term's postings in order of documents; ``next`` is the document it stands at."""

    def __init__(self, segment: Segment, term: int, weight: int):
        self.segment, self.weight = segment, weight
        self.b, self.end = int(segment.start[term]), int(segment.start[term + 1])
        self.at, self.next = 0, segment.first[self.b]

    def add_until(self, stop: int, base: int, scores: np.ndarray) -> bool:
        """Adds to scores (from document base on) what stands before ``stop``; whether postings are left."""
        while self.next < stop:
            doc, factors = self.segment.block(self.b)
            cut = int(doc.searchsorted(stop)) if doc[-1] >= stop else len(doc)
            scores[doc[self.at : cut] - base] += self.weight * factors[self.at : cut]
            if cut < len(doc):
                self.at, self.next = cut, int(doc[cut])
            else:
                self.b, self.at = self.b + 1, 0
                if self.b == self.end:
                    return False
                self.next = self.segment.first[self.b]
        return True


def _rank(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, doc_id if doc_id is not None else 0


def search(segment: Segment, terms: list[tuple[str, int]], best: list[tuple], k: int) -> list[tuple]:
    """The k best (score, id) among ``best`` and a segment's documents, for terms with their weights."""
    cursors = [Cursor(segment, at, w) for t, w in terms if w > 0 and (at := segment.place.get(t)) is not None]
    least = best[-1][0] if len(best) == k else 1
    if sum(w * int(segment.best[at]) for t, w in terms if (at := segment.place.get(t)) is not None) < least:
        return best
    heap = [(c.next, n) for n, c in enumerate(cursors)]
    heapq.heapify(heap)
    scores = np.zeros(SPAN, dtype=np.int64)
    while heap:
        base = heap[0][0]
        scores[:] = 0
        while heap and heap[0][0] < base + SPAN:
            n = heap[0][1]
            if cursors[n].add_until(base + SPAN, base, scores):
                heapq.heapreplace(heap, (cursors[n].next, n))
            else:
                heapq.heappop(heap)
        at = np.flatnonzero(scores >= least)
        if len(at):
            at = at[np.lexsort((at, -scores[at]))[:k]]
            best = heapq.nsmallest(k, chain(best, ((int(scores[a]), segment.docs[base + a]) for a in at.tolist())), key=_rank)
            least = best[-1][0] if len(best) == k else 1
    return best


def _searcher(items, n_docs: int, n_words: int, k: int, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                row = {f: one.column(f)[0].as_py() for f in ("docs", "terms", "heads", "lens", "df", "postings")}
                segment = Segment(row, n_docs, n_words)
                for n, (_, _, terms) in enumerate(asked):
                    best[n] = search(segment, terms, best[n], k)
        found = [(number, name, doc, score) for (number, name, _), own in zip(asked, best, strict=True) for score, doc in own]
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        kind = (pa.int64(), *kinds, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kind, strict=True)], names=["number", "item_id", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of a score above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    item_kind, doc_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    terms = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(item_text), F.lit(""))), F.lit(LOWERED), F.lit(0))
    # Numbered, as items need not have ids of their own; the numbers are fixed once written.
    asked = scratch.write(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    known = None
    if total <= vocabulary:
        known = frozenset(w.encode() for w in asked.select(F.explode("terms").alias("t")).distinct().toArrow()["t"].to_pylist())
    index = scratch.write(build_index(docs, id_col, text_col, known))
    n_docs, n_words = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_words")).first())
    found = None
    for b in range(blocks := max(1, -(-total // words))):
        own = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)
        mine = own.select(F.explode("terms").alias("term")).distinct()
        df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df")).join(mine, "term", "left_semi").toArrow()
        weights = {t: weight(n_docs, d) for t, d in zip(df["term"].to_pylist(), df["df"].to_pylist(), strict=True)}
        rows = own.toArrow()
        each = [(number, name, [(t, c * weights[t]) for t, c in Counter(ts).items() if t in weights]) for number, name, ts in zip(*(rows[c].to_pylist() for c in ("number", "item_id", "terms")), strict=True)]
        run = _searcher(spark.sparkContext.broadcast(each), n_docs, n_words, k, (to_arrow_type(item_kind), to_arrow_type(doc_kind)))
        part = index.mapInArrow(tidy(run), f"number long, item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_words) AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS number, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
qt AS (SELECT number, item_id, term, count(*) AS times FROM (SELECT number, item_id, unnest(w) AS term FROM q) AS x GROUP BY ALL),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) AS x WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
sc AS (SELECT number, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM qt JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
