"""Shared pieces of the training-data operators: scratch tables, word hashing, link components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of every word contract: space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, unlike ``lower`` which folds all of Unicode."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(n)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = "/tmp/modesift-scratch"
    return set_dir.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/ms-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def draw(df: DataFrame, key: str, sample: int, seed: int = 0) -> DataFrame:
    """At most ``sample`` rows by a hash of the key. A threshold on the hash lets little more than that
    through first, so no task and no merge ever orders many times the sample."""
    n = df.count()
    h = F.xxhash64(F.lit(seed), F.col(key))
    if n > sample:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / n + 1e-6)))
    return df.orderBy(h, key).limit(sample)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """run, and after it what it has freed goes back to the system: workers are reused by the next stages."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def arrow_rows(batch: pa.RecordBatch, max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about max_bytes; a longer text stands alone."""
    sizes = np.diff(text_offsets(batch.column(column)))
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def text_offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1]
    return off.astype(np.int64)


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, nulls as empty."""
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


# --- hashing of words, whole batches at a time --------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WINDOW = 1 << 21


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def _pow() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, made by the workers that hash."""
    return _powers(_P, _WINDOW + 1), _powers(_P_INV, _WINDOW + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and polynomial hash of each word of a buffer of at most _WINDOW bytes."""
    gap = np.ones(len(buf) + 2, dtype=bool)
    gap[1:-1] = _SPACE[buf]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])[: len(buf)]
    ends = np.flatnonzero(~gap[1:] & np.append(gap[2:], True))
    ends = ends[: len(starts)] + 1
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    power, inverse = _pow()
    np.cumsum(_BYTE[_LOWER[buf]] * power[: len(buf)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mix64(hashes + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text (A-Z lower-cased), one after another, and each text's
    number of words. Texts longer than a window are cut at white space; a single word longer than
    that is hashed by itself."""
    counts = np.zeros(len(texts), dtype=np.int64)
    parts: list[np.ndarray] = []
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            lens = np.array([len(texts[i]) + 1 for i in group])
            starts, hashes = _window_words(np.frombuffer(b"\n".join(texts[i] for i in group), dtype=np.uint8))
            owner = np.searchsorted(np.cumsum(lens), starts, side="right")
            counts[group] = np.bincount(owner, minlength=len(group))
            parts.append(hashes)
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) + 1 > _WINDOW:
            flush()
            own = [_long_words(text)]
            counts[i] = len(own[0])
            parts.extend(own)
            continue
        if held + len(text) + 1 > _WINDOW:
            flush()
        group.append(i)
        held += len(text) + 1
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), counts


def _long_words(text: bytes) -> np.ndarray:
    out, words, held = [], [], 0

    def flush() -> None:
        nonlocal words, held
        if words:
            out.append(_window_words(np.frombuffer(b"\n".join(words), dtype=np.uint8))[1])
        words, held = [], 0

    for word in text.split():
        if len(word) + 1 > _WINDOW:
            flush()
            value = 0
            for k in range(0, len(word), _WINDOW):
                piece = _LOWER[np.frombuffer(word[k : k + _WINDOW], dtype=np.uint8)]
                part = int((_BYTE[piece] * _pow()[0][: len(piece)]).sum(dtype=np.uint64))
                value = (value * 0x100000001B3 + part) % 2**64
            out.append(mix64(np.array([(value + len(word)) % 2**64], dtype=np.uint64)))
            continue
        if held + len(word) + 1 > _WINDOW:
            flush()
        words.append(word)
        held += len(word) + 1
    flush()
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The set of each text's word shingles as sorted 64-bit hashes. Fewer words than the width: the
    whole sequence is the one shingle; no words: the empty set."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    mixed = np.zeros(n, dtype=np.uint64)
    if n >= width:
        acc = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - width + 1 + k] + np.uint64(k + 1))
        mixed[: len(acc)] = acc
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(mixed[at : at + c - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            value = 0x51AB1E5
            for h in hashes[at : at + c].tolist():
                value = (value * 0xD6E8FEB86659FD93 + h + 1) % 2**64
            out.append(mix64(np.array([(value + c) % 2**64], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


# --- components of links ------------------------------------------------------------------------


def components(spark: SparkSession, links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of links(a, b): comp is the smallest node reachable.

    Alternates large-star and small-star steps: each keeps the components and shortens the paths, a
    logarithmic number of rounds in practice. Each step is a grouped minimum and a join back, so a
    node with very many neighbours is never gathered in one place. Every round is a written table.
    """

    def star(edges: DataFrame, keep_larger: bool) -> DataFrame:
        if keep_larger:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if keep_larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        after = scratch.write(star(star(edges, True), False))
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return nodes.unionByName(roots)
