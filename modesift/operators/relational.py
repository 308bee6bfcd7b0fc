"""Keyed joins of a run: labels, overrides, provenance, folds; and frequency clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import RunTables
from . import chains

DECISIONS = ("GOOD", "BAD", "REVIEW")
#: Rows of a group that one task may scan.
HOT = 2_000_000


def binary_label(c: Column) -> Column:
    """1 good, 0 bad, NULL otherwise."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("good", "g", "1"), 1).when(v.isin("bad", "b", "0"), 0)


def decision(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.isin("G", "GOOD"), "GOOD").when(v.isin("B", "BAD"), "BAD").when(v.isin("R", "REVIEW"), "REVIEW")


def mode_key(path: Column) -> Column:
    """The last three parts of a path if the middle one is N and digits, else NULL."""
    key = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+/[Nn][0-9]+/[^/]+)$", 1)
    return F.when(key != "", key)


def shot_relative(path: Column, shot: Column) -> Column:
    """The path from its first part that is the shot on; the whole path if none is."""
    at = F.instr(F.concat(F.lit("/"), path), F.concat(F.lit("/"), shot, F.lit("/")))
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)


def match_keys(path: Column, with_two: bool = False) -> Column:
    """The keys under which a path can be matched: itself, its last three parts, and if asked its last two."""
    parts = F.split(path, "/")
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), "/")
    return F.array_distinct(F.array(path, tail(3), *([tail(2)] if with_two else [])))


def fingerprint(parts: list[tuple[str, Column]], tag: str = "MODE_INPUT_V1") -> Column:
    """SHA-256 of the tag, a zero byte, and for each labelled part its label, a zero byte, its size in 16
    bytes (big-endian) and its bytes. Pass the tag of existing fingerprints to match them."""
    pieces = [F.encode(F.lit(tag), "utf-8"), F.unhex(F.lit("00"))]
    for label, content in parts:
        size = F.lpad(F.hex(F.octet_length(content).cast("long")), 32, "0")
        pieces += [F.encode(F.lit(label), "utf-8"), F.unhex(F.lit("00")), F.unhex(size), content.cast("binary")]
    return F.sha2(F.concat(*pieces), 256)


def last_wins(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value of each key, how many rows it had, in the order of first appearance (first_seq)."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value), F.count("*").alias("n_rows"), F.min(seq).alias("first_seq"))


def label_match(scored: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: keys matched, scored without label, labelled without score."""
    both = scored.select(key).distinct().withColumn("s", F.lit(1)).join(labels.select(key).distinct().withColumn("l", F.lit(1)), key, "full")
    s, l = F.col("s").isNotNull(), F.col("l").isNotNull()  # noqa: E741
    return both.agg(F.count_if(s & l).alias("matched"), F.count_if(s & ~l).alias("unmatched_scored"), F.count_if(~s & l).alias("labeled_not_scored"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """rows with override_status and its message, final_decision, decision_source, and of applied overrides
    what the reviewer wrote. Undecided override rows don't count. The first that applies of: none, key not
    unique on either side, stale fingerprint, ineligible decision, applied. Only the keys of the overrides
    are counted among the rows, so these meet one small table and are never grouped themselves.
    keys: the same mode_keys from a plan that is cheaper to read twice than rows."""
    given = overrides.where(F.trim(F.coalesce("manual_decision", F.lit(""))) != "")
    told = ("manual_reason", "reviewer", "adjudication_timestamp")
    given = given.withColumns({c: F.lit(None).cast("string") for c in told if c not in overrides.columns})
    given = given.groupBy(F.trim("mode_key").alias("o_key")).agg(F.count("*").alias("o_n"), F.first("manual_decision").alias("o_decision"), F.first(F.lower("input_fingerprint")).alias("o_print"), *(F.first(c).alias(f"o_{c}") for c in told))
    found = (rows if keys is None else keys).select(F.col("mode_key").alias("k_key"))
    counts = found.join(given.select(F.col("o_key").alias("k_key")), "k_key", "left_semi").groupBy("k_key").agg(F.count("*").alias("k_n"))
    d = rows.join(given.join(counts, F.col("o_key") == F.col("k_key")).drop("k_key"), F.col("mode_key") == F.col("o_key"), "left")
    eligible = F.coalesce(F.col("rule_decision").isin(*DECISIONS), F.lit(False))
    status = (
        F.when(F.col("o_n").isNull(), F.when(eligible, "NOT_PRESENT").otherwise(""))
        .when((F.col("k_n") != 1) | (F.col("o_n") != 1), "AMBIGUOUS_OVERRIDE")
        .when(~F.col("o_print").eqNullSafe(F.col("input_fingerprint")), "STALE_FINGERPRINT")
        .when(~eligible, "INELIGIBLE_DECISION")
        .otherwise("APPLIED")
    )
    d = d.withColumn("override_status", status)
    said = F.col("override_status")
    applied = said == "APPLIED"
    message = F.when(said == "AMBIGUOUS_OVERRIDE", "the key is not unique among the rows or the overrides").when(said == "STALE_FINGERPRINT", "the inputs have changed since the review").when(said == "INELIGIBLE_DECISION", "only GOOD, BAD and REVIEW can be overridden")
    d = d.withColumns({"final_decision": F.when(applied, decision(F.col("o_decision"))).otherwise(F.col("rule_decision")), "decision_source": F.when(applied, "manual_override").otherwise("rule_engine"), "manual_decision": F.when(applied, decision(F.col("o_decision"))), "override_message": message, **{c: F.when(applied, F.col(f"o_{c}")) for c in told}})
    return d.drop("k_n", "o_key", "o_n", "o_decision", "o_print", *(f"o_{c}" for c in told))


def manifest(training: DataFrame, reference: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (path, shot, file_kind, size, sha256) of two trees and the paths a label list names, compared:
    one full outer join on the path."""
    t = training.select("path", F.col("shot").alias("t_shot"), F.col("file_kind").alias("t_kind"), F.col("size").alias("training_size"), F.col("sha256").alias("training_sha256"))
    r = reference.select("path", F.col("shot").alias("r_shot"), F.col("file_kind").alias("r_kind"), F.col("size").alias("reference_size"), F.col("sha256").alias("reference_sha256"))
    known = listed.select("path", F.col("shot").alias("l_shot"), F.col("label").alias("training_label"))
    d = t.join(r, "path", "full").join(known, "path", "full")
    a, b = F.col("training_sha256"), F.col("reference_sha256")
    status = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "identical").otherwise("different")).when(a.isNotNull(), "training_only").when(b.isNotNull(), "reference_only").otherwise("missing_both")
    return d.select(
        "path", F.coalesce("t_shot", "r_shot", "l_shot").alias("shot"), F.coalesce("t_kind", "r_kind", F.lit("mode")).alias("file_kind"), F.col("l_shot").isNotNull().alias("in_training_csv"), F.coalesce("training_label", F.lit("")).alias("training_label"),
        status.alias("status"), "training_size", "reference_size", "training_sha256", "reference_sha256",
    )


def provenance_summary(rows: DataFrame) -> DataFrame:
    """Status counts by shot and kind, and an overall verdict."""
    st, kind = F.col("status"), F.col("file_kind")
    n = lambda c: F.count_if(c).cast("long")
    out = rows.groupBy("shot").agg(
        n(F.col("in_training_csv")).alias("canonical_rows"), n(F.col("in_training_csv") & (st == "missing_both")).alias("canonical_missing_both"),
        *(n((kind == "mode") & (st == s)).alias(f"mode_{s}") for s in ("identical", "different", "training_only", "reference_only", "missing_both")),
        *(n((kind == "datcon") & (st == s)).alias(f"datcon_{s}") for s in ("identical", "different", "training_only", "reference_only")),
    )
    m = F.col("mode_different") + F.col("mode_training_only") + F.col("mode_reference_only") + F.col("mode_missing_both") > 0
    c = F.col("datcon_different") + F.col("datcon_training_only") + F.col("datcon_reference_only") > 0
    return out.withColumn("overall_status", F.when(m & c, "mode_and_continuum_mismatch").when(m, "mode_mismatch").when(c, "continuum_mismatch").otherwise("active_payload_aligned"))


def _joins(v: float, anchor: float, tolerance: float) -> bool:
    return abs(v - anchor) / max(abs(anchor), 1e-12) < tolerance


def _cluster_scan(group: list[str], value: str, tolerance: float):
    """Appends cluster_index to rows sorted by group and value. What is kept between batches is one row's
    group, the anchor and the index; the end of a cluster is found by bisection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, index = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for name in group:
                a, b = batch.column(name).slice(1), batch.column(name).slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            first = tuple(batch.column(name)[0].as_py() for name in group)
            new[0] = first != last
            last = tuple(batch.column(name)[n - 1].as_py() for name in group)
            v = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out = np.zeros(n, dtype=np.int32)
            cuts = [*np.flatnonzero(new).tolist(), n]
            if cuts[0]:
                cuts = [0, *cuts]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if new[start]:
                    anchor, index = None, 0
                i = start
                while i < stop:
                    if anchor is None or not _joins(v[i], anchor, tolerance):
                        anchor, index = (None if np.isnan(v[i]) else float(v[i])), index + 1
                    low, high = i + 1, stop  # the first row from here on that doesn't join; a row without value joins nothing
                    if anchor is None:
                        high = low
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (mid + 1, high) if _joins(v[mid], anchor, tolerance) else (low, mid)
                    out[i:low] = index
                    i = low
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "cluster_index"])

    return run


def frequency_clusters(df: DataFrame, group: list[str], value: str, key: str, tolerance: float = 0.02, hot: int = HOT, tables: RunTables | None = None) -> DataFrame:
    """cluster_index per row: in order of value, a row joins the cluster while its distance from the
    cluster's first member, relative to that, is below the tolerance. Rows without value are clusters of
    their own. Groups of up to ``hot`` rows take one shuffle and a streaming scan in sorted order, so that
    none is gathered; larger ones are dealt to ranges of values (``chains``). Both give the same."""
    rows = df.select(*group, key, value)
    large = rows.groupBy(*group).agg(F.count("*").alias("cluster__n")).where(F.col("cluster__n") > hot)
    if large.isEmpty():
        return _scanned(rows, group, value, key, tolerance)
    tables = tables or RunTables(df.sparkSession)
    large = tables.stage("hot_groups", lambda: large)
    match = [rows[c].eqNullSafe(large[c]) for c in group]
    cold = _scanned(rows.join(large, match, "left_anti"), group, value, key, tolerance)
    return cold.unionByName(chains.chain_clusters(rows.join(large, match, "left_semi"), group, value, key, tolerance, tables, part=max(1, hot // 2)))


def _scanned(rows: DataFrame, group: list[str], value: str, key: str, tolerance: float) -> DataFrame:
    rows = rows.repartition(*group).sortWithinPartitions(*group, value, key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_cluster_scan(group, value, tolerance), f"{schema}, cluster_index int")


def fold_counts(df: DataFrame, shot: str, label: str) -> DataFrame:
    """For each fold (a shot left out): rows by split and label, from one count a shot."""
    own = df.groupBy(F.col(shot).alias("fold")).agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_good"), F.count_if(F.col(label) == 0).alias("n_bad"))
    whole = Window.partitionBy()
    counts = ("n_rows", "n_good", "n_bad")
    test = own.select("fold", F.lit("test").alias("split"), *counts)
    train = own.select("fold", F.lit("train").alias("split"), *((F.sum(c).over(whole) - F.col(c)).alias(c) for c in counts))
    return test.unionByName(train).withColumn("n_other", F.col("n_rows") - F.col("n_good") - F.col("n_bad"))


def disagreements(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Rows whose prediction at 1/2 differs from the label, most confident first."""
    return df.where(F.col(truth).isNotNull() & ((F.col(score) >= 0.5).cast("int") != F.col(truth))).withColumn("confidence", F.abs(F.col(score) - 0.5)).orderBy(F.desc("confidence"))


def label_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose label differs between two lists."""
    return old.select(key, F.col("label").alias("old_label")).join(new.select(key, F.col("label").alias("new_label")), key).where(~F.col("old_label").eqNullSafe(F.col("new_label")))


def label_disagreements(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Labels of several sources side by side (full outer), with how they disagree."""
    out = None
    for name, d in sources.items():
        one = d.select(key, F.col("label").alias(f"{name}_label"))
        out = one if out is None else out.join(one, key, "full")
    labels = [F.col(f"{n}_label") for n in sources]
    given = F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))
    missing = F.exists(F.array(*labels), lambda x: x.isNull())
    return out.withColumn("disagreement", F.when(F.size(given) > 1, "conflict").when(missing, "missing").otherwise("agree"))


def mode_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Modes of two trees: equal shapes, equal arrays, largest difference, relative change of omega."""
    x = a.select(key, F.col("mode").alias("m_a"), F.col("omega").alias("w_a"))
    y = b.select(key, F.col("mode").alias("m_b"), F.col("omega").alias("w_b"))
    shape = (F.size("m_a") == F.size("m_b")) & (F.size(F.get("m_a", F.lit(0))) == F.size(F.get("m_b", F.lit(0))))
    gap = F.array_max(F.zip_with(F.flatten("m_a"), F.flatten("m_b"), lambda p, q: F.abs(p - q)))
    return x.join(y, key).select(key, shape.alias("shape_equal"), (shape & F.col("m_a").eqNullSafe(F.col("m_b"))).alias("array_equal"), F.when(shape, gap).alias("max_abs_delta"), F.try_divide(F.col("w_b") - F.col("w_a"), F.abs("w_a")).alias("relative_omega"))


def in_list(df: DataFrame, listed: DataFrame, path: str = "path", with_two: bool = False) -> DataFrame:
    """Rows whose path shares a key with a listed one."""
    keys = lambda d: d.select(path, F.explode(match_keys(F.col(path), with_two)).alias("match_key"))
    hits = keys(df.select(path)).join(keys(listed.select(path)).select("match_key").distinct(), "match_key", "left_semi").select(path).distinct()
    return df.join(hits, path, "left_semi")


def not_done(df: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Rows to resume with: those not in the log."""
    hits = in_list(df.select(path), done, path)
    return df.join(hits, path, "left_anti")


def changed_modes(diff: DataFrame) -> DataFrame:
    """Over modes that differ between trees: how many, how many in shape, and by how much."""
    d = diff.where(~F.coalesce("array_equal", F.lit(False)) | (F.col("relative_omega") != 0))
    change = F.abs("relative_omega")
    return d.agg(F.count("*").alias("n_changed"), F.count_if(~F.col("shape_equal")).alias("n_shape"), F.median(change).alias("median_abs_relative_omega"), F.max(change).alias("max_abs_relative_omega"), F.max("max_abs_delta").alias("max_abs_delta"))


def changed_by_shot(changed: DataFrame, training: DataFrame, reference: DataFrame) -> DataFrame:
    """For files (path, shot) that differ between trees of modes(path, mode, omega, load_error): how many by
    shot, of unequal arrays, of another shape, how far omega is apart, and how many can't be compared."""
    side = lambda d, name: d.select("path", F.struct("mode", "omega", "load_error").alias(name))
    both = changed.select("path", "shot").join(side(training, "a"), "path", "left").join(side(reference, "b"), "path", "left")
    size = lambda m: F.struct(F.size(m), F.size(F.get(m, F.lit(0))))
    lost = F.col("a.mode").isNull() | F.col("b.mode").isNull()
    change = F.when(~lost, F.try_divide(F.abs(F.col("b.omega") - F.col("a.omega")), F.abs("a.omega")))
    count = lambda c: F.count_if(~lost & c).cast("long")
    return both.groupBy("shot").agg(
        F.count("*").alias("n_changed"), count(~F.col("a.mode").eqNullSafe(F.col("b.mode"))).alias("n_structure"), count(size(F.col("a.mode")) != size(F.col("b.mode"))).alias("n_shape"),
        F.median(change).alias("median_abs_relative_omega"), F.max(change).alias("max_abs_relative_omega"), F.count_if(lost).cast("long").alias("n_not_compared"),
    )


def resolve_path(path: Column, root: str) -> Column:
    """Absolute paths as they are, others below the data root."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
