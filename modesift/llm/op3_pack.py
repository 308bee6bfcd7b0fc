"""Best-fit packing under conflicts: documents into sequences of a fixed number of words.

A document longer than the capacity is cut into full pieces, each a bin of its own, and a rest that is
packed like a short document; every word lands in exactly one piece. Pieces are placed longest first.
Open bins are held by residual: a bitmap of the residuals in use gives the successor of a size, that
is the tightest bin it fits, and the search goes on to the next residual until a bin is compatible.
Each bin carries two bitmaps: duplicate clusters already in it (equal normalised texts, or a given
column: never twice in a bin) and sources that have filled their ``source_share`` of it (no more of
those). A hot source or group of copies thus spreads over bins instead of filling them.

Pieces are dealt to shards of about ``shard_docs`` by a hash of id and content, so no source, cluster
or key decides where rows go, and a shard is packed by itself; only sizes and keys travel, no text.

Defined results: null or empty text is a piece of no words and gets a place (bin of its shard like any
other); null ids and sources are kept, null being one source; ids that are no integers are kept as text; repeated rows are copies of one cluster
and get different bins; equal sizes are placed by id; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import documents, lower_ascii, text_or_empty, word_count

CAPACITY = 2048
SCHEMA = "piece long, bin_id long, position long, n_words long, bin_words long"


def place(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, source_share: float) -> tuple[list[int], list[int]]:
    """Bin and position in it of each piece, taken in the order given."""
    limit = source_share * capacity
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0  # bit r: some open bin has residual r
    full_sources: list[int] = []
    held: list[int] = []
    filled: list[dict[int, int]] = []
    count: list[int] = []
    bins, positions = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, (1 << cluster if cluster >= 0 else 0)
        found = -1
        rest = in_use >> size
        at = size
        while rest:
            skip = (rest & -rest).bit_length() - 1
            at += skip
            for k, b in enumerate(by_residual[at]):
                if not (full_sources[b] & source_bit or held[b] & cluster_bit) and filled[b].get(source, 0) + size <= max(limit, size if not count[b] else 0):
                    found = b
                    by_residual[at].pop(k)
                    if not by_residual[at]:
                        in_use &= ~(1 << at)
                    break
            if found >= 0:
                break
            rest >>= skip + 1
            at += 1
        if found < 0:
            found, at = len(count), capacity
            full_sources.append(0)
            held.append(0)
            filled.append({})
            count.append(0)
        bins.append(found)
        positions.append(count[found])
        count[found] += 1
        held[found] |= cluster_bit
        filled[found][source] = filled[found].get(source, 0) + size
        if filled[found][source] >= limit:
            full_sources[found] |= source_bit
        left = at - size
        by_residual[left].append(found)
        in_use |= 1 << left
    return bins, positions


def _packer(capacity: int, source_share: float):
    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        frame = frame.sort_values(["n_words", "cluster", "no_id", "doc_id", "piece"], ascending=[False, True, True, True, True], kind="stable")
        cluster, names = pd.factorize(frame["cluster"])
        many = pd.Series(cluster).map(pd.Series(cluster).value_counts()).to_numpy() > 1
        dense = pd.factorize(pd.Series(cluster).where(many))[0]  # only repeated clusters need a bit
        source = pd.factorize(frame["source"], use_na_sentinel=False)[0]
        bins, positions = place(frame["n_words"].tolist(), source.tolist(), dense.tolist(), capacity, source_share)
        ids = frame["doc_id"].astype("Int64" if frame["doc_id"].dtype.kind == "i" else object).mask(frame["no_id"])
        out = frame[["piece", "n_words"]].assign(doc_id=ids, bin_id=[shard * 2**32 + b for b in bins], position=positions)
        out["bin_words"] = out.groupby("bin_id")["n_words"].transform("sum")
        return out[["doc_id", "piece", "bin_id", "position", "n_words", "bin_words"]]

    return pack


def pack(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cluster_col: str | None = None, capacity: int = CAPACITY, source_share: float = 0.5, shard_docs: int = 2048, seed: int = 3) -> DataFrame:
    """One row a piece: doc_id, piece, bin_id, position in the bin, n_words and the bin's words."""
    text = text_or_empty(text_col)
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(lower_ascii(F.trim(text)))
    kind = "long" if isinstance(df.schema[id_col].dataType, IntegralType) else "string"
    named = F.coalesce(F.col(id_col).cast(kind), F.lit(0 if kind == "long" else "").cast(kind)).alias("doc_id")  # a null among integers would make pandas round them
    rows = df.select(named, F.col(id_col).isNull().alias("no_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("words"), cluster.alias("cluster"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("draw"))
    shards = max(1, -(-df.select(id_col).count() // shard_docs))
    last = F.greatest(F.lit(0), F.ceil(F.col("words") / capacity) - 1).cast("long")
    pieces = rows.select("doc_id", "no_id", "source", "cluster", "draw", "words", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("draw", "piece"), F.lit(shards)))
    # Equal rows are counted before the shuffle and dealt to shards one after the other.
    copies = pieces.groupBy("shard", "doc_id", "no_id", "piece", "source", "cluster", "n_words").agg(F.count("*").alias("rows"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    copies = copies.withColumn("shard", F.pmod(F.col("shard") + F.col("copy"), F.lit(shards))).drop("rows", "copy")
    return copies.groupBy("shard").applyInPandas(_packer(capacity, source_share), f"doc_id {kind}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text", "source"))
