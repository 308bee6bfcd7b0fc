"""Readers of the pipeline's own file formats, through Spark's readers only."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.profiles import clean_boundaries
from ..operators.relational import decision, fingerprint

MODE_SCHEMA = "path string, shot string, expected_n int, file string, omega double, gamma_d double, ntor int, nr int, nhar int, mode array<array<double>>, load_error string, size long, sha256 string, input_fingerprint string"


def decode_mode(content: bytes) -> dict:
    """A mode file: float64 values omega, three payload blocks of nhar x nr (the first is kept), nr, gamma_d, ntor."""
    if len(content) % 8 or len(content) < 32:
        raise ValueError(f"{len(content)} bytes are no float64 mode file")
    f = np.frombuffer(content, dtype=np.float64)
    nr = int(f[-3])
    if nr < 1 or (len(f) - 4) % (3 * nr):
        raise ValueError(f"{len(f) - 4} payload values don't divide by 3 x {nr}")
    mode = f[1:-3].reshape(3, -1, nr)[0]
    return {"omega": float(f[0]), "gamma_d": float(f[-2]), "ntor": int(np.rint(f[-1])), "nr": nr, "nhar": len(mode), "mode": [row.tolist() for row in mode]}


def encode_mode(mode: np.ndarray, omega: float, gamma_d: float, ntor: int) -> bytes:
    nhar, nr = mode.shape
    return np.concatenate([[omega], np.asarray(mode, dtype=float).ravel(), np.zeros(2 * nhar * nr), [nr, gamma_d, ntor]]).tobytes()


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below root/<shot>/N<k>/ by name pattern, content included (pruned when not selected)."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/*/N*/")
    part = F.split("path", "/")
    return d.select("path", F.element_at(part, -3).alias("shot"), F.regexp_extract(F.element_at(part, -2), "^N([0-9]+)$", 1).alias("n_text"), F.element_at(part, -1).alias("file"), "modificationTime", "length", "content").where("n_text <> ''").withColumn("expected_n", F.col("n_text").cast("int")).drop("n_text")


def _own_continuum(spark: SparkSession, root: str) -> DataFrame:
    """The files datcon<N> of the groups N<N>."""
    return listing(spark, root, "datcon*").where(F.col("file") == F.concat(F.lit("datcon"), F.col("expected_n").cast("string")))


def read_modes(spark: SparkSession, root: str, n_min: int | None = None, n_max: int | None = None, tag: str | None = None) -> DataFrame:
    """One row a mode file egn*; a file that cannot be decoded keeps its row with load_error. The input
    fingerprint covers the bytes of the mode and of its group's boundary file (NULL without one); it is
    made where the mode is read, so files are read once. tag: that of existing fingerprints."""
    boundaries = _own_continuum(spark, root).select("shot", "expected_n", F.col("content").alias("boundary"))
    d = listing(spark, root, "egn*").join(boundaries, ["shot", "expected_n"], "left")
    parts = [("mode", F.col("content")), ("datcon", F.col("boundary"))]
    d = d.withColumn("input_fingerprint", fingerprint(parts, tag) if tag else fingerprint(parts))
    if n_min is not None:
        d = d.where(F.col("expected_n") >= n_min)
    if n_max is not None:
        d = d.where(F.col("expected_n") <= n_max)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["omega", "gamma_d", "ntor", "nr", "nhar", "mode", "load_error"]
        for frame in frames:
            rows = []
            for content in frame["content"]:
                try:
                    rows.append(decode_mode(bytes(content)) | {"load_error": None})
                except (ValueError, OverflowError) as e:
                    rows.append({"load_error": f"{type(e).__name__}: {e}"})
            found = pd.DataFrame(rows, columns=names, index=frame.index, dtype=object)
            found = found.where(found.notna(), None)
            yield pd.concat([frame.drop(columns="content"), found], axis=1)[["path", "shot", "expected_n", "file", *names, "size", "sha256", "input_fingerprint"]]

    d = d.select("path", "shot", "expected_n", "file", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "input_fingerprint")
    return d.mapInPandas(run, MODE_SCHEMA)


def parse_continuum(text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """i1, i2 (1-based, inclusive) and the cleaned squared boundaries on these radii."""
    lines = text.splitlines()
    head = lines[0].split() if lines else []
    if len(head) < 2:
        raise ValueError("short header")
    i1, i2 = int(head[0]), int(head[1])
    data = np.array([[float(x) for x in line.split()[:2]] for line in lines[1:] if line.strip()], dtype=float)
    if data.shape != (i2 - i1 + 1, 2):
        raise ValueError(f"{data.shape} values for {i1}..{i2}")
    return i1, i2, *clean_boundaries(data[:, 0], data[:, 1])


def read_continuum(spark: SparkSession, root: str) -> DataFrame:
    """One row a file datcon<N> in N<N>/: shot, n, i1, i2, low, high (NULL where undefined), error."""
    d = _own_continuum(spark, root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda a: [None if np.isnan(v) else float(v) for v in a]
        for frame in frames:
            rows = []
            for content in frame["content"]:
                try:
                    i1, i2, low, high = parse_continuum(bytes(content).decode())
                    rows.append((i1, i2, plain(low), plain(high), None))
                except ValueError as e:
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            found = pd.DataFrame(rows, columns=["i1", "i2", "low", "high", "continuum_error"], index=frame.index, dtype=object)
            yield pd.concat([frame[["shot", "n"]], found], axis=1)

    return d.select("shot", F.col("expected_n").alias("n"), "content").mapInPandas(run, "shot string, n int, i1 int, i2 int, low array<double>, high array<double>, continuum_error string")


def with_continuum(modes: DataFrame, continuum: DataFrame) -> DataFrame:
    """Modes with low2 and high2 placed on their radial grid; NULL arrays where there is no usable file.
    Profiles are one row a group, so Spark broadcasts them if they are small and shuffles by key if not."""
    c = continuum.select(F.col("shot").alias("c_shot"), "n", "i1", "i2", "low", "high", "continuum_error")
    d = modes.join(c, (F.col("shot") == F.col("c_shot")) & (F.col("expected_n") == F.col("n")), "left")
    place = lambda a: F.when(F.col(a).isNotNull() & (F.col("i2") <= F.col("nr")), F.transform(F.sequence(F.lit(1), F.col("nr")), lambda i: F.get(a, i - F.col("i1"))))
    return d.withColumns({"low2": place("low"), "high2": place("high")}).drop("c_shot", "n", "i1", "i2", "low", "high")


def preflight(spark: SparkSession, root: str) -> DataFrame:
    """(shot, expected_n) of the populated groups without a continuum file."""
    have = _own_continuum(spark, root).select("shot", "expected_n")
    return listing(spark, root, "egn*").select("shot", "expected_n").distinct().join(have, ["shot", "expected_n"], "left_anti")


# --- lists -----------------------------------------------------------------------------------------

PATH_NAMES, LABEL_NAMES = ("path", "file", "filename", "mode", "mode_path"), ("label", "validity", "class", "y")
VALIDITIES, FAMILIES = ("good", "bad"), ("tae", "eae", "mixed")
_LABELS = {"good", "bad", "g", "b", "1", "0", "review"}


# A whole cell: quoted with what may follow its closing quote, or plain. All repetitions are possessive, so
# that matching neither goes back nor recurses, however long the line.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_PLAIN = r'(?:[^",][^,]*+)?+'
_CELL = rf'(?:"{_QUOTED}"{_PLAIN}|{_PLAIN})'
_OPENED = rf'^(?:{_CELL},)*+"{_QUOTED}$'
_STILL_OPEN = rf'^{_QUOTED}(?:"{_PLAIN},(?:{_CELL},)*+"{_QUOTED})?+$'
_CSV = {"mode": "PERMISSIVE", "escape": '"'}


def _open_before(d: DataFrame, group: list[str], order: str) -> DataFrame:
    """d with before0 and before1: whether a quote is open before the row if none or one was open before its
    group. A row maps the state before it to the state after it (after0, after1): it fixes the state, turns
    it or keeps it, so the state is that of the last row that fixed it, turned as often as rows did since."""
    so_far = Window.partitionBy(*group).orderBy(order)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("after0") & ~F.col("after1"), 1).otherwise(0)
    d = d.withColumn("turned", F.sum(turns).over(so_far))
    fixed = F.max(F.when(F.col("after0") == F.col("after1"), F.struct(order, "after0", "turned"))).over(earlier)
    d = d.withColumn("fixed", fixed).withColumn("turned_before", F.col("turned") - turns)

    def state(start: bool) -> Column:
        odd = (F.col("turned_before") - F.coalesce("fixed.turned", F.lit(0))) % 2 == 1
        return F.coalesce("fixed.after0", F.lit(start)) != odd

    return d.withColumn("before0", state(False)).withColumn("before1", state(True)).drop("turned", "fixed", "turned_before")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): the records of CSV files in the order of names and lines, blank ones left out. A record
    goes on over line breaks within quotes (they become \\n), also over the border of two file blocks: states are
    found within blocks, then over one row a block. A file that ends within quotes fails the read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = _open_before(lines.withColumn("after0", F.col("value").rlike(_OPENED)).withColumn("after1", F.col("value").rlike(_STILL_OPEN)), ["file", "block"], "at")
    after = [F.max_by(F.when(F.col(f"before{k}"), F.col("after1")).otherwise(F.col("after0")), "at").alias(f"after{k}") for k in (0, 1)]
    blocks = _open_before(lines.groupBy("file", "block").agg(*after, *(F.count_if(~F.col(f"before{k}")).alias(f"starts{k}") for k in (0, 1))), ["file"], "block")
    ends = blocks.groupBy("file").agg(F.max_by(F.when(F.col("before0"), F.col("after1")).otherwise(F.col("after0")), "block").alias("open")).where("open").limit(1).collect()
    if ends:
        raise ValueError(f"{ends[0].file}: ends within quotes")
    # One row a block of a file: few enough for one ordered sum.
    starts = F.when(F.col("before0"), F.col("starts1")).otherwise(F.col("starts0"))
    first = F.coalesce(F.sum(starts).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", F.col("before0").alias("open"), first.alias("first"))
    d = lines.join(blocks, ["file", "block"]).withColumn("begins", ~F.when(F.col("open"), F.col("before1")).otherwise(F.col("before0")))
    seq = F.col("first") - 1 + F.count_if("begins").over(Window.partitionBy("file", "block").orderBy("at"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    return d.withColumn("seq", seq).groupBy("seq").agg(F.array_join(parts["value"], "\n").alias("value")).where("trim(value) <> ''")


def _strip(cell: Column) -> Column:
    return F.trim(cell, F.lit(" \t\n\r\x0b\f"))


def _cells(record: str) -> list[str]:
    return next(csv.reader(record.splitlines(keepends=True)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(seq, path, label) of a list with or without header; blank and # records are skipped. The roles of
    the columns are inferred from the header or the first 20 rows."""
    lines = _records(spark, path).where("not startswith(trim(value), '#')")
    head = [_cells(r.value) for r in lines.orderBy("seq").limit(21).collect()]
    if not head:
        return spark.createDataFrame([], "seq long, path string, label string")
    first = [x.strip().lower() for x in head[0]]
    named = any(x in PATH_NAMES for x in first)
    width = max(map(len, head))
    rows = head[1:] if named else head[:20]
    at = next((i for i, x in enumerate(first) if x in PATH_NAMES), 0) if named else next((i for i in range(width) if any(i < len(r) and "/" in r[i] for r in rows)), 0)
    label = next((i for i, x in enumerate(first) if x in LABEL_NAMES), None) if named else None
    if label is None:
        label = next((i for i in range(width) if i != at and rows and all(i < len(r) and r[i].strip().lower() in _LABELS for r in rows)), None)
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), _CSV)
    d = lines.select("seq", cells.alias("c"))
    if named:
        d = d.where(F.col("seq") != lines.agg(F.min("seq")).first()[0])
    return d.select("seq", _strip(F.col(f"c.c{at}")).alias("path"), (_strip(F.col(f"c.c{label}")) if label is not None else F.lit(None).cast("string")).alias("label"))


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV as strings under unique names (x, x_2, ...), in file order; blank and # records
    are skipped, short rows padded with ''. Without a path column in its first line the file has no header:
    its columns are path, validity or col2, family or col3, col4 and so on, by the values they hold."""
    lines = _records(spark, path).where("not startswith(trim(value), '#')")
    top = lines.orderBy("seq").limit(1).collect()
    if not top:
        raise ValueError(f"{path}: no rows")
    first = [x.strip() for x in _cells(top[0].value)]
    named = any(x.lower() in PATH_NAMES for x in first)
    # No row has more cells than commas and one.
    width = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0]
    cells = F.from_csv(F.col("value"), ", ".join(f"c{i} string" for i in range(width)), _CSV | {"nullValue": "\u0000"})
    rows = lines.select("seq", cells.alias("x")).select("seq", F.filter(F.array("x.*"), lambda x: x.isNotNull()).alias("c"))
    if named:
        rows = rows.where(F.col("seq") != top[0].seq)
    # Two columns' values tell the roles; each is a set of distinct values of which one beyond the known settles it.
    known = lambda i, names: bool(rows.where(F.size("c") > i).select(F.lower(_strip(F.get("c", F.lit(i)))).alias("v")).where("v <> ''").agg(F.count("*") > 0, F.coalesce(F.every(F.col("v").isin(*names)), F.lit(False))).first()[:] == (True, True))
    width = max(len(first), rows.agg(F.max(F.size("c"))).first()[0] or 0)
    if named:
        names = [x or f"col{i + 1}" for i, x in enumerate(first)]
    else:
        names = ["path", *(["validity" if known(1, VALIDITIES) else "col2"] if width > 1 else []), *(["family" if known(2, FAMILIES) else "col3"] if width > 2 else [])]
    names += [f"col{i + 1}" for i in range(len(names), width)]
    seen: dict[str, int] = {}
    unique = []
    for x in names:
        seen[x] = seen.get(x, 0) + 1
        unique.append(x if seen[x] == 1 else f"{x}_{seen[x]}")
    return rows.orderBy("seq").select(*(F.coalesce(_strip(F.get("c", F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(unique)))


def read_strict(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV whose header must be non-blank and unique (and equal columns if given), every row as wide."""
    lines = _records(spark, path)
    top = lines.orderBy("seq").limit(1).collect()
    names = _cells(top[0].value) if top else []
    if not names or any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValueError(f"{path}: header must have unique non-blank names")
    if columns is not None and names != columns:
        raise ValueError(f"{path}: expected columns {columns}, found {names}")
    cells = F.from_csv("value", ", ".join(f"`{n.replace('`', '``')}` string" for n in names), _CSV | {"mode": "FAILFAST"})
    return lines.where(F.col("seq") > top[0].seq).orderBy("seq").select(cells.alias("c")).select("c.*")


# Fixed by the file format.
OVERRIDE_COLUMNS = ["mode_key", "path", "input_fingerprint", "ntor", "frequency", "original_rule_decision", "manual_decision", "manual_reason", "reviewer", "adjudication_timestamp"]


def read_overrides(spark: SparkSession, path: str, columns: list[str] = OVERRIDE_COLUMNS) -> DataFrame:
    """Override rows, trimmed, decisions in full and fingerprints in lower case; blank rows are skipped, the
    first invalid row fails the read."""
    d = read_strict(spark, path, columns)
    d = d.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns))
    d = d.where(F.array_join(F.array(*columns), "") != "").withColumn("input_fingerprint", F.lower("input_fingerprint"))
    given, full = F.col("manual_decision") != "", decision(F.col("manual_decision"))
    bad = F.when(~given & (F.col("manual_reason") != ""), "manual_decision").when(given & full.isNull(), "manual_decision")
    for name, wrong in (("manual_reason", F.col("manual_reason") == ""), ("mode_key", F.col("mode_key") == ""), ("input_fingerprint", ~F.col("input_fingerprint").rlike("^[0-9a-f]{64}$")), ("reviewer", F.col("reviewer") == ""), ("adjudication_timestamp", F.col("adjudication_timestamp") == "")):
        bad = bad.when(given & wrong, name)
    wrong = d.select(bad.alias("bad"), "mode_key").where("bad is not null").limit(1).collect()
    if wrong:
        raise ValueError(f"override {wrong[0].mode_key}: {wrong[0].bad} is missing or invalid")
    return d.withColumn("manual_decision", F.coalesce(full, F.lit("")))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """(path, shot, label) of a training list; unsafe or repeated paths fail the read."""
    d = read_labels(spark, path).select("path", "label").withColumn("shot", F.get(F.split("path", "/"), F.lit(0)))
    unsafe = d.where("startswith(path, '/') or path rlike '(^|/)[.][.]?(/|$)' or not path rlike '^[^/]+/N[0-9]+/[^/]+$'").limit(1).collect()
    if unsafe:
        raise ValueError(f"unsafe path {unsafe[0].path}")
    twice = d.groupBy("path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated path {twice[0].path}")
    return d
