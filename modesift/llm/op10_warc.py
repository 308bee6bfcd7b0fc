"""Merkle fixity audit of WARC replicas.

Every replica has trees of its own layout: the leaves of a file's tree are its records, each by its
offset, length and the SHA-256 of its bytes; a node above stands for one offset range (``BASE`` bytes,
then ``fanout`` times as many a level) and hashes, in order, what begins in its range; the root hashes
the file's widest ranges. The replicas are compared at the roots; only below a root, then below a
range, that differs are the next level's nodes compared, down to the lowest ranges, and only the
records of those are compared one by one. Trees are built by grouped aggregation on hashes, so no
record's bytes leave the scan, and no group holds more than the records of one lowest range or the
ranges below one node.

A record is ``ok`` where the replica has the same bytes at the same offset, ``moved`` where the file
has them at another one, ``corrupt`` where it has other bytes under its id, ``missing`` where it has
none; what only the replica has is ``extra``. Records with one id in one file are matched by their
bytes first, then in order of their offsets.

Defined results: null url or html is written as empty; records with a null id are matched like those
of one more id, and dealt to files by their bytes like all others, as are repeated rows (by number);
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

FILE_RECORDS = 200
BASE, FANOUT = 1 << 14, 8
LEVELS = 5  # the widest ranges have BASE * FANOUT^4 = 64 MB

_HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text: header block, payload, two line ends."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit(_HEAD), s(page_id), F.lit(">\r\nWARC-Target-URI: "), s(url), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(s(html)).cast("string"), F.lit("\r\n\r\n"), s(html), F.lit("\r\n\r\n"))


def _records(data: bytes, at: int, stop: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    while at < stop:
        end = data.find(b"\r\n\r\n", at, stop)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = headers.get("Content-Length", "")
        after = end + 4 + (int(size) if size.isdigit() else stop) + 4
        if after > stop:
            raise ValueError(f"the WARC record at byte {at} is cut")
        yield at, after - at, headers, data[at:after]
        at = after


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, bytes) of the records of a WARC file; raises on a broken or cut record.
    In a compressed file each record is a gzip member: offset and length are the member's, the bytes
    those of the record, and one member is unpacked at a time."""
    if not data.startswith(b"\x1f\x8b"):
        yield from _records(data, 0, len(data))
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            raw = member.decompress(view[at:])
        except zlib.error as e:
            raise ValueError(f"no gzip member at byte {at}") from e
        if not member.eof:
            raise ValueError(f"the gzip member at byte {at} is cut")
        length = len(data) - at - len(member.unused_data)
        found = list(_records(raw, 0, len(raw)))
        if len(found) != 1:
            raise ValueError(f"the gzip member at byte {at} holds {len(found)} records")
        yield at, length, found[0][2], raw
        at += length


_WARC = "file string, offset long, length long, record_id string, uri string, leaf string, error string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, error = [], None
            try:
                for at, n, h, raw in parse_warc(data.as_py()):
                    rows.append((name, at, n, h.get("WARC-Record-ID"), h.get("WARC-Target-URI", ""), hashlib.sha256(raw).hexdigest(), None))
            except ValueError as e:
                error = str(e)
            if error is not None:
                rows.append((name, None, None, None, None, None, error))
            kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=[c.split()[0] for c in _WARC.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path, plain or compressed: file, offset, length, record_id, uri,
    leaf (SHA-256 of the record's bytes), and error. A file that breaks off gives what stands before and
    one row with the error. A file is one value of ``binaryFile``, so it may have 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_scan, _WARC)


def layout(records: DataFrame, files: int) -> DataFrame:
    """records(record_id, length, leaf, ...) dealt to files: with file, ordinal and offset in it."""
    # Rows that repeat are told apart by a number, so a hot row is dealt like any others.
    counted = records.groupBy(*records.columns).agg(F.count("*").alias("copies"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("")), "leaf", F.col("copy").cast("string")))
    filed = each.withColumn("file", F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.lit(files))
    order = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_last(), "leaf", "copy")
    return filed.withColumn("ordinal", F.row_number().over(order).cast("long") - 1).withColumn("offset", _before(order)).drop("copy")


def _before(order) -> Column:
    return F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def _range(base: int, fanout: int, level: int) -> Column:
    return F.floor(F.col("offset") / F.lit(base * fanout ** (level - 1))).cast("long")


def tree(leaves: DataFrame, scratch: Scratch, base: int = BASE, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (side, file, node, hash) of the trees over leaves(side, file, offset, length, leaf): the
    lowest ranges first, the roots last. A level is a written table, read by the next one."""
    hashed = lambda under, *cols: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*under))), lambda u: F.concat_ws(":", *(u[c].cast("string") for c in cols))), ","), 256).alias("hash")
    at = leaves.withColumn("node", _range(base, fanout, 1))
    out = [scratch.write(at.groupBy("side", "file", "node").agg(hashed(("offset", "length", "leaf"), "offset", "length", "leaf")))]
    for k in range(2, levels + 2):
        up = F.floor(F.col("node") / fanout) if k <= levels else F.lit(0)
        below = out[-1].select("side", "file", up.cast("long").alias("up"), "node", "hash")
        out.append(scratch.write(below.groupBy("side", "file", "up").agg(hashed(("node", "hash"), "node", "hash")).withColumnRenamed("up", "node")))
    return out


def descend(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, node) of the lowest ranges in which the sides differ, found from the roots down."""
    differs = F.max(F.when(F.col("side") == 0, F.col("hash"))).eqNullSafe(F.max(F.when(F.col("side") == 1, F.col("hash"))))
    bad = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        if bad is not None:
            up = F.floor(F.col("node") / fanout) if k < len(levels) - 2 else F.lit(0)
            nodes = nodes.withColumn("up", up.cast("long")).join(bad.withColumnRenamed("node", "up"), ["file", "up"], "left_semi")
        bad = nodes.groupBy("file", "node").agg(differs.alias("same")).where("not same").select("file", "node")
    return bad


def audit(ours: DataFrame, theirs: DataFrame, base: int = BASE, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Both as (record_id, file, offset, length, leaf), each by its own layout: each of our records with
    its verdict, then what only theirs has as ``extra`` with its place there."""
    scratch = Scratch(ours.sparkSession)
    cols = ["record_id", "file", "offset", "length", "leaf"]
    leaves = scratch.write(ours.select(F.lit(0).alias("side"), *cols).unionByName(theirs.select(F.lit(1).alias("side"), *cols)))
    bad = scratch.write(descend(tree(leaves, scratch, base, fanout, levels), fanout))
    ranged = leaves.withColumn("node", _range(base, fanout, 1))
    fine = ranged.where("side = 0").join(bad, ["file", "node"], "left_anti").select(*cols, F.lit("ok").alias("verdict"))
    # The same place and bytes, then the same id and bytes, then the same id; equals are numbered.
    left = ranged.join(bad, ["file", "node"], "left_semi").drop("node").withColumn("verdict", F.lit(None).cast("string"))
    for verdict, by in (("ok", ["offset", "length", "leaf", "record_id"]), ("moved", ["record_id", "leaf"]), ("corrupt", ["record_id"])):
        own = Window.partitionBy("side", "file", *by, F.col("verdict").isNull()).orderBy("offset")
        met = Window.partitionBy("file", *by, F.col("verdict").isNull(), "number")
        left = left.withColumn("number", F.row_number().over(own)).withColumn("sides", F.count("*").over(met))
        left = scratch.write(left.withColumn("verdict", F.when(F.col("verdict").isNull() & (F.col("sides") == 2), F.lit(verdict)).otherwise(F.col("verdict"))).drop("number", "sides"))
    alone = F.when(F.col("side") == 0, F.lit("missing")).otherwise(F.lit("extra"))
    told = left.where("side = 0 or verdict is null").select(*cols, F.coalesce("verdict", alone).alias("verdict"))
    return fine.unionByName(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits all pages against a replica with known damage: a changed byte where page_id % 97 = 3, a lost
    record where page_id % 131 = 5, which leaves a hole in files of even number and moves what follows in
    the others."""
    pages, scratch = spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark)
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    hurt = F.when(F.col("page_id") % 97 == 3, F.sha2(F.concat(F.lit("X"), F.substring(record, 2, 2**31 - 1)), 256))
    records = pages.select(F.col("page_id").alias("record_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("leaf"), hurt.alias("hurt"))
    ours = scratch.write(layout(records, max(1, -(-pages.count() // FILE_RECORDS))))
    theirs = ours.where("record_id is null or record_id % 131 <> 5").withColumn("leaf", F.coalesce("hurt", "leaf"))
    theirs = theirs.withColumn("offset", F.when(F.col("file") % 2 == 0, F.col("offset")).otherwise(_before(Window.partitionBy("file").orderBy("ordinal"))))
    out = audit(ours, theirs)
    return out.select(F.col("record_id").alias("page_id"), F.col("file").alias("warc_file"), F.col("offset").alias("byte_offset"), F.col("length").alias("n_bytes"), F.col("leaf").alias("record_sha256"), "verdict")


ORACLE = f"""
WITH r AS (
  SELECT page_id, '{_HEAD.replace(chr(13), "").replace(chr(10), "@@")}' AS h,
    coalesce(url, '') AS u, coalesce(html, '') AS b FROM pages),
rec AS (
  SELECT page_id, replace(h, '@@', chr(13) || chr(10)) || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(b)::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || b || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM r),
hashed AS (SELECT page_id, strlen(t)::BIGINT AS n_bytes, sha256(t) AS record_sha256 FROM rec),
copied AS (SELECT *, row_number() OVER (PARTITION BY page_id, record_sha256 ORDER BY n_bytes) AS copy FROM hashed),
leaf AS (
  SELECT *, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || ':' || record_sha256 || ':' || copy::VARCHAR), 1, 8))::BIGINT
    % (SELECT greatest(1, (count(*) + {FILE_RECORDS - 1}) // {FILE_RECORDS}) FROM pages) AS warc_file FROM copied),
placed AS (
  SELECT *, coalesce(sum(n_bytes) OVER w, 0)::BIGINT AS byte_offset, coalesce(sum((page_id % 131 = 5)::INT) OVER w, 0) AS lost
  FROM leaf WINDOW w AS (PARTITION BY warc_file ORDER BY page_id NULLS LAST, record_sha256, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, warc_file::BIGINT AS warc_file, byte_offset, n_bytes, record_sha256,
  CASE WHEN page_id % 131 = 5 THEN 'missing' WHEN page_id % 97 = 3 THEN 'corrupt' WHEN warc_file % 2 = 1 AND lost > 0 THEN 'moved' ELSE 'ok' END AS verdict
FROM placed
"""
