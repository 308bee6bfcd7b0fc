"""Benchmark decontamination: a broadcast set of the items' word windows, a scan of all document windows.

Words are what remains of a text between bytes that are neither letters, digits nor outside ASCII; A-Z
count as a-z. A window is ``width`` words of an item one after another; an item with fewer words is one
window. Items are turned into a vocabulary and, by length, a table of windows as rows of word numbers,
sorted by hash. Documents become arrays of word numbers (0: not in the vocabulary); stretches without 0
are hashed window by window and looked up, and what is found is verified number by number, so a hit is
a hit of the words themselves. Nothing is shuffled: documents keep their rows, partitions and columns.

Bound of the broadcast: items are cut to parts of ``PART`` words that overlap by a window, and parts are
dealt to as many blocks as hold about ``WORDS`` words each (some 60 bytes a word in a worker). There is
one block for benchmarks up to that size; for larger ones each block is one more pass over the documents,
between which they are written to the shared folder.

Defined results: null and empty texts have no words and no hits; items without words are no windows;
items without an id mark words but are not among a document's items; repeated items count once by their
id, repeated documents each for itself; an empty benchmark hits nothing; other columns pass through
(the prefix ``leak__`` is reserved).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, documents, lower_ascii, mix64, text_bytes, tidy

WIDTH = 10
WORDS, PART = 1 << 20, 1 << 16
BATCH, PIECE = 1 << 21, 1 << 20  # bytes of text at once; of one text whose words are split at once
#: Words of a lower-cased text, and of one that is not.
LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FOUND = "n_words long, items array<string>, ranges array<struct<first: long, last: long, start: long, end: long>>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of about PIECE bytes."""
    text = text.translate(_WORD_BYTES)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


class Windows:
    """The windows of items as numbers of their words, to be looked up by hash and compared."""

    def __init__(self, items: list[str | None], texts: list[str], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        self.items = sorted({i for i in items if i is not None})
        place = {x: k for k, x in enumerate(self.items)}
        for item, text in zip(items, texts, strict=True):
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in text.encode().split()], dtype=np.int32)
            if not len(ids):
                continue
            length = min(width, len(ids))
            own = np.lib.stride_tricks.sliding_window_view(ids, length)
            rows.setdefault(length, []).append(own)
            owners.setdefault(length, []).append(np.full(len(own), place.get(item, -1), dtype=np.int64))
        self.tables = {n: self._table(np.concatenate(rows[n]), np.concatenate(owners[n])) for n in sorted(rows)}

    @staticmethod
    def _table(rows: np.ndarray, owners: np.ndarray) -> tuple:
        """Distinct windows by hash, where each one's items start among ``owners``, and how many share a hash at most."""
        rows, at = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([at.reshape(-1), owners]), axis=0)
        hashes = _hash(rows.reshape(-1), np.arange(len(rows)) * rows.shape[1], rows.shape[1])
        order = np.argsort(hashes, kind="stable")
        start = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        hashes = hashes[order]
        most = int(np.unique(hashes, return_counts=True)[1].max())
        return hashes, rows[order], start[order], start[order + 1], pairs[:, 1].copy(), most

    def numbers(self, text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: where in ids a window stands, and which one."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0, dtype=np.int32)])
        for length, (hashes, rows, _, _, _, most) in self.tables.items():
            if len(ids) < length:
                continue
            known = np.flatnonzero(unknown[length:] == unknown[:-length])
            for k in range(0, len(known), 1 << 17):
                at = known[k : k + (1 << 17)]
                h = _hash(ids, at, length)
                found = np.searchsorted(hashes, h)
                for r in range(most):
                    row = np.minimum(found + r, len(hashes) - 1)
                    same = np.flatnonzero((found + r < len(hashes)) & (hashes[row] == h))
                    same = same[(ids[at[same][:, None] + np.arange(length)] == rows[row[same]]).all(axis=1)]
                    if len(same):
                        yield length, at[same], row[same]

    def find(self, texts: list[bytes]) -> list[tuple[int, list[str], list[dict]]]:
        """n_words, items and ranges of each text: words first to last (exclusive), code points start to end."""
        ids, counts = [], []
        for text in texts:
            own = self.numbers(text)
            counts.append(len(own))
            ids += [own, np.zeros(1, dtype=np.int32)]  # no window across two texts
        starts = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
        firsts: dict[int, list[np.ndarray]] = {}
        items: dict[int, set[int]] = {}
        for length, at, row in self.hits(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)):
            owner = np.searchsorted(starts, at, side="right") - 1
            _, _, begin, end, names, _ = self.tables[length]
            for d in np.unique(owner).tolist():
                mine = owner == d
                firsts.setdefault(d, []).append(np.column_stack([at[mine] - starts[d], at[mine] - starts[d] + length]))
                for r in np.unique(row[mine]).tolist():
                    items.setdefault(d, set()).update(names[begin[r] : end[r]].tolist())
        out = []
        for d, text in enumerate(texts):
            ranges = _merged(np.concatenate(firsts[d])) if d in firsts else []
            out.append((counts[d], [self.items[k] for k in sorted(items.get(d, ())) if k >= 0], _placed(text, ranges) if len(ranges) else []))
        return out


def _hash(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(at), length, dtype=np.uint64)
    for k in range(length):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + ids[at + k].astype(np.uint64))
    return h


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted ranges without overlap; those that touch are one."""
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.column_stack([ranges[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(ranges) - 1)]])


def _placed(text: bytes, ranges: np.ndarray) -> list[dict]:
    """Ranges of words with the code points that they take up."""
    out, todo = [], iter(ranges.tolist())
    first, last = next(todo)
    start = 0
    for k, m in enumerate(ANY_CASE.finditer(text.decode("utf-8", "replace"))):
        if k == first:
            start = m.start()
        if k == last - 1:
            out.append({"first": first, "last": last, "start": start, "end": m.end()})
            first, last = next(todo, (-1, -1))
            if first < 0:
                break
    return out


def _finder(windows):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            found = []
            for part in arrow_rows(pa.RecordBatch.from_arrays([texts], names=["text"]), BATCH):
                found += windows.value.find(text_bytes(part.column("text")))
            yield pa.array([{"n_words": n, "items": items, "ranges": ranges} for n, items, ranges in found], _FOUND_TYPE)

    return F.arrow_udf(tidy(run), FOUND, F.ArrowUDFType.SCALAR_ITER)


_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])))])


def item_parts(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, text, n): the words of items, of each at most PART and the window after them, joined by a space."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(LOWERED), F.lit(0))
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    cuts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(PART))
    rows = rows.select("item", "words", F.explode(cuts).alias("at"))
    part = F.slice("words", F.col("at") + 1, F.lit(PART + width - 1))
    return rows.select("item", F.array_join(part, " ").alias("text"), F.size(part).alias("n")).distinct()


def _joined_ranges(ranges):
    """Ranges of several blocks as one sorted list without overlap."""
    def add(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(done) > 0) & (x["first"] <= last["last"])
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    kind = "array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>"
    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add)


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, words: int = WORDS) -> DataFrame:
    """docs with ``leak__found``: n_words, the items with a window in the text, and the ranges hit."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    parts = scratch.write(item_parts(items, item_col, item_text, width))
    blocks = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // words))
    out = docs
    for b in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).select("item", "text").toArrow()
        windows = spark.sparkContext.broadcast(Windows(own["item"].to_pylist(), own["text"].to_pylist(), width))
        out = out.withColumn(f"leak__{b}", _finder(windows)(text_col))
        if blocks > 1:
            out = scratch.write(out)
    scratch.drop(parts)
    if blocks == 1:
        return out.withColumnRenamed("leak__0", "leak__found")
    each = [F.col(f"leak__{b}") for b in range(blocks)]
    found = F.struct(each[0]["n_words"].alias("n_words"), F.array_sort(F.array_distinct(F.concat(*(x["items"] for x in each)))).alias("items"), _joined_ranges(F.concat(*(x["ranges"] for x in each))).alias("ranges"))
    return out.withColumn("leak__found", found).drop(*(f"leak__{b}" for b in range(blocks)))


def hit_words() -> Column:
    return F.aggregate("leak__found.ranges", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])


def without_documents(docs: DataFrame, items: DataFrame, share: float = 0.0, **args) -> DataFrame:
    """docs without those of whose words more than the share stand in a window of an item."""
    return scan(docs, items, **args).where(~(hit_words() > share * F.col("leak__found.n_words"))).drop("leak__found")


def without_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", filler: str = " ", **args) -> DataFrame:
    """docs with ``filler`` in place of what the ranges hit; null texts stay null."""
    spans = F.col("leak__found.ranges")
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(spans, (k - 1).cast("int"))["end"])
    start = lambda k: F.coalesce(F.get(spans, k.cast("int"))["start"], F.length(text_col))
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring(F.col(text_col), (end(k) + 1).cast("int"), (start(k) - end(k)).cast("int")))
    clean = F.when(F.size(spans) > 0, F.array_join(pieces, filler)).otherwise(F.col(text_col))
    return scan(docs, items, text_col, **args).withColumn(text_col, clean).drop("leak__found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    items = F.col("leak__found.items")
    digest = F.sha2(F.array_join(F.array_sort(items), ","), 256)
    return found.select("doc_id", F.col("leak__found.n_words").alias("n_words"), hit_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"), digest.alias("items_sha256"), (hit_words() > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_hit FROM h, unnest(range(0, n)) AS t(k) GROUP BY rid),
its AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) AS x GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
