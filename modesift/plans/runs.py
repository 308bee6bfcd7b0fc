"""Whole runs: from files to decisions, reports and evaluations.

A sort is a row of stage tables (``RunTables``): inputs routed, rows decided, scores, near-duplicates, and
the sorted rows that every report reads. Arrays are written once, in the first; of the others only rows
that are still to be scored or compared keep theirs. Give a sort the same tables again and it goes on
after its last whole stage.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, gates, ml
from ..operators import features as X
from ..operators import relational as R
from ..operators import scoring as S
from ..sources import files, sinks
from ..sources.tables import RunTables


def load(spark: SparkSession, root: str, n_min: int | None = None, n_max: int | None = None, strict: bool = False, tag: str | None = None) -> DataFrame:
    """Mode files of all shots below root with their boundaries, keys and input fingerprints, checked. A shot
    of which a populated group has no boundary file is not run: its rows say so (strict: it raises)."""
    lack = files.preflight(spark, root)
    if strict and (first := lack.orderBy("shot", "expected_n").limit(20).collect()):
        raise FileNotFoundError("no continuum file for " + ", ".join(f"{r.shot}/N{r.expected_n}" for r in first))
    d = files.with_continuum(files.read_modes(spark, root, n_min, n_max, tag), files.read_continuum(spark, root))
    d = X.validate(d.withColumn("mode_key", R.mode_key(F.col("path"))))
    halted = lack.select(F.col("shot").alias("halted")).distinct()
    d = d.join(halted, F.col("shot") == F.col("halted"), "left")
    return d.withColumn("rejection_reason", F.when(F.col("halted").isNotNull(), "missing_continuum_group").otherwise(F.col("rejection_reason"))).drop("halted")


def preprocess(df: DataFrame, tae_fraction: float = 0.5, eae_fraction: float = 0.4, eae_delta: float = -0.1) -> DataFrame:
    """Validated modes routed by gap region; rejected rows are kept with their reason."""
    d = X.route(X.upper_gap(df), tae_fraction, eae_fraction, eae_delta)
    ok = F.col("rejection_reason") == ""
    d = d.withColumn("rejection_reason", F.when(ok & F.col("low2").isNull(), "continuum_load_failed").when(ok & F.col("gap_region").isNull(), "continuum_scalar_failed").otherwise(F.col("rejection_reason")))
    return d.withColumn("gap_region", F.when(F.col("rejection_reason") == "", F.col("gap_region")))


def split_gap(df: DataFrame) -> DataFrame:
    """below_upper2, above_upper2 or mixed with the two scalars as text of four decimals."""
    d = preprocess(df)
    name = F.when(F.col("gap_region") == "tae_like", "below_upper2").when(F.col("gap_region") == "eae_like", "above_upper2").when(F.col("gap_region") == "mixed", "mixed")
    four = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit(""))
    return d.select("path", name.alias("gap_group"), four("signed_delta").alias("signed_delta"), four("fraction_below_upper2").alias("fraction_below_upper2"), "rejection_reason")


def _scored(df: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The rows to score, scored, and the others; the filter stands before any Python stage."""
    go = (F.col("rejection_reason") == "") & (F.col("gap_region") != "eae_like")
    d = df.where(go)
    for name, score in scorers.items():
        d = score(d) if name != "features" else d
    return d, df.where(~F.coalesce(go, F.lit(False)))


def _arrays(rows: DataFrame) -> list[str]:
    """The columns that hold a mode's inputs: large, and of no use to reports."""
    return [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]


def _only_where(rows: DataFrame, arrays: list[str], keep) -> DataFrame:
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in arrays})


def _with_marks(rows: DataFrame, arrays: list[str], marks: DataFrame) -> DataFrame:
    """rows without their arrays, with what near-duplicates say of them; a path that has no mark is not selected."""
    return rows.drop(*arrays).join(marks, "path", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def sort_mixed(df: DataFrame, score_rf: Callable[[DataFrame], DataFrame], score_cnn: Callable[[DataFrame], DataFrame], group: tuple[str, ...] = ("shot", "ntor"), tables: RunTables | None = None, **dedup_args) -> DataFrame:
    """All rows of a mixed run, without their arrays: scores, fusion, flags and ``selected`` after
    near-duplicates among the good."""
    tables = tables or RunTables(df.sparkSession)
    routed = tables.stage("routed", lambda: X.radial(preprocess(df)).drop("w", "r", "w_sum"))
    arrays = _arrays(routed)

    def fused() -> DataFrame:
        d, rest = _scored(routed, {"rf": score_rf, "cnn": score_cnn})
        d = _only_where(S.flagged(S.fuse(d)), arrays, F.col("final_label") == "good")
        return d.unionByName(_only_where(rest, arrays, F.lit(False)), allowMissingColumns=True)

    rows = tables.stage("fused", fused)
    good = rows.where("final_label = 'good'").withColumn("score", F.col("p_avg"))
    marks = dedup.representatives(good.select(*group, "path", "omega", "score", "mode"), list(group), "path", tables=tables, **dedup_args)
    return tables.stage("sorted", lambda: _with_marks(rows, arrays, marks.select("path", "cluster_index", "type_index", "selected")))


def sort_rules(df: DataFrame, overrides: DataFrame | None = None, cfg: gates.GateConfig = gates.GateConfig(), score: Callable[[DataFrame], DataFrame] | None = None, group: tuple[str, ...] = ("shot", "ntor"), tables: RunTables | None = None) -> DataFrame:
    """All rows of a rule run, without their arrays: gates, overrides, final decisions and ``selected``
    among the GOOD. Without a scorer, or where it leaves a cluster member without score, all members of the
    cluster stay."""
    tables = tables or RunTables(df.sparkSession)
    routed = tables.stage("routed", lambda: preprocess(df))
    arrays = _arrays(routed)

    def decided() -> DataFrame:
        go = (F.col("rejection_reason") == "") & F.col("gap_region").isin("tae_like", "mixed")
        ruled = gates.evaluate(X.radial(routed.where(go)).drop("w", "r", "w_sum"), cfg)
        rest = routed.where(~F.coalesce(go, F.lit(False))).withColumn("rule_decision", F.when(F.col("rejection_reason") != "", "INVALID").otherwise("EAE")).withColumn("primary_reason", F.upper("rejection_reason"))
        rows = ruled.unionByName(rest, allowMissingColumns=True)
        if overrides is not None:
            rows = R.apply_overrides(rows, overrides, keys=routed)
        else:
            blank = {c: F.lit(None).cast("string") for c in ("override_message", "manual_decision", "manual_reason", "reviewer", "adjudication_timestamp")}
            rows = rows.withColumns({"override_status": F.when(F.col("rule_decision").isin(*R.DECISIONS), "NOT_PRESENT").otherwise(""), "final_decision": F.col("rule_decision"), "decision_source": F.lit("rule_engine"), **blank})
        return _only_where(rows, arrays, F.col("final_decision") == "GOOD")

    rows = tables.stage("decided", decided)
    good = rows.where("final_decision = 'GOOD'")
    if score is None:
        return tables.stage("sorted", lambda: rows.drop(*arrays).withColumn("selected", F.col("final_decision") == "GOOD"))
    scored = tables.stage("scored", lambda: score(good).select(*group, "path", "omega", "score", "mode"))
    marks = dedup.representatives(scored.fillna({"score": 0.0}), list(group), "path", tables=tables)
    marks = tables.stage("types", lambda: marks.join(scored.select("path", F.col("score").alias("duplicate_rank_score")), "path"))
    whole = [*group, "cluster_index"]
    open_ = marks.where("duplicate_rank_score is null").select(*(F.col(c).alias(f"open__{c}") for c in whole)).distinct().withColumn("keep_all", F.lit(True))
    picked = marks.join(open_, [F.col(c).eqNullSafe(F.col(f"open__{c}")) for c in whole], "left")
    picked = picked.select("path", "cluster_index", "type_index", (F.col("selected") | F.coalesce("keep_all", F.lit(False))).alias("selected"), "duplicate_rank_score")
    return tables.stage("sorted", lambda: _with_marks(rows, arrays, picked))


def sort_single(df: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.5, group: tuple[str, ...] = ("shot", "ntor"), tables: RunTables | None = None) -> DataFrame:
    """A run with one model, without arrays: label by threshold, near-duplicates among the good."""
    tables = tables or RunTables(df.sparkSession)
    arrays = _arrays(df)
    labelled = lambda: score(df.where("rejection_reason = ''")).withColumn("final_label", F.when(F.col("score") >= threshold, "good").otherwise("bad"))
    rows = tables.stage("scored", lambda: _only_where(labelled(), arrays, F.col("final_label") == "good"))
    marks = dedup.representatives(rows.where("final_label = 'good'").select(*group, "path", "omega", "score", "mode"), list(group), "path", tables=tables)
    return tables.stage("sorted", lambda: _with_marks(rows, arrays, marks.select("path", "cluster_index", "type_index", "selected")))


# Column names and file names of a run's outputs, fixed by their readers.
MIXED_COLUMNS = [
    "path", "shot", "n", "ntor", "nr", "nhar", "omega", "gamma_d", "rad_loc", "rad_width", "status", "gap_region", "signed_delta", "fraction_below_upper2", "p_rf_good", "p_cnn_good", "p_avg",
    "final_label", "tier", "model_disagreement", "near_threshold", "large_score_gap", "selected_final", "rejection_reason", "error_message",
]
RULE_COLUMNS = [
    "path", "mode_key", "shot", "n", "ntor", "nr", "nhar", "omega", "gamma_d", "rad_loc", "rad_width", "input_fingerprint", "processing_status", "gap_region", "signed_delta", "fraction_below_upper2",
    "preprocessing_primary_reason", "rule_decision", "rule_primary_reason", "rule_triggered_rules", "rule_version", "rule_features", "manual_decision", "manual_reason", "reviewer", "adjudication_timestamp",
    "override_status", "override_message", "final_decision", "decision_source", "duplicate_rank_score", "duplicate_rank_source", "selected_final", "diagnostic_message",
]
RULE_VERSION = "tae-rules-axis-grid-cont-window-edge-v7"
RULE_ORDER = ["shot", "rules__n", "rules__omega", "rules__file", "rules__key"]
CLUSTER_COLUMNS = ["ntor", "cluster_index", "type_group", "path", "omega", "action", "score"]


def _filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with every column of an output; what a run has not made is NULL and written as ''."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})


def _errors(rows: DataFrame) -> list:
    return [F.col(c) for c in ("load_error", "continuum_error", "measure_error") if c in rows.columns]


def mixed_rows(rows: DataFrame) -> DataFrame:
    """The 25 columns of a mixed run's lists."""
    c = F.col
    d = rows if "rad_loc" in rows.columns else X.radial(rows)
    status = F.when(c("rejection_reason") != "", "rejected").when(c("gap_region") == "eae_like", "eae_like").otherwise("scored")
    d = d.withColumns({"n": c("expected_n"), "status": status, "p_rf_good": c("p_rf"), "p_cnn_good": c("p_cnn"), "large_score_gap": c("score_gap"), "selected_final": F.when(status == "scored", c("selected")), "error_message": F.coalesce(*_errors(rows), F.lit(""))})
    return _filled(d, MIXED_COLUMNS)


def rule_rows(rows: DataFrame) -> DataFrame:
    """The 34 columns of a rule run's lists; rule_features is nested here and JSON in a file."""
    c = F.col
    evaluated = (c("rejection_reason") == "") & (c("gap_region") != "eae_like")
    d = rows if "rad_loc" in rows.columns else X.radial(rows)
    pick = lambda prefix: F.struct(*(F.col(k) for k in d.columns if k.startswith(prefix)))
    crossing = F.struct(*(F.col(k) for k in ("n_cross", "r_star_max", "W_star_max", "W_star_sum", "r_star_high_shear", "W_star_high_shear", "W_star_high_shear_sum") if k in d.columns), pick("cross_window_").alias("window"))
    features = F.struct(
        F.struct(pick("grid_scale_").alias("grid_scale_spike")).alias("numerical_structure_features"), crossing.alias("crossing_features"), F.col("crossings").alias("crossing_records"),
        pick("ext_").alias("extremum_features"), F.struct(pick("axis_").alias("axis_artifact"), pick("edge_").alias("edge_artifact")).alias("boundary_features"),
    )
    status = F.when(c("rejection_reason") != "", "INVALID").when(c("gap_region") == "eae_like", "ROUTED_EAE").when(c("rule_decision") == "INVALID", "INVALID").otherwise("RULE_EVALUATED")
    blank = F.lit(None).cast("string")
    final = lambda x: F.when(status == "ROUTED_EAE", blank).otherwise(x)
    ranked = F.col("duplicate_rank_score") if "duplicate_rank_score" in d.columns else F.lit(None).cast("double")
    d = d.withColumns({
        "n": c("expected_n"), "processing_status": status, "preprocessing_primary_reason": F.when(c("rejection_reason") != "", F.upper("rejection_reason")), "rule_decision": F.when(evaluated, c("rule_decision")), "rule_primary_reason": F.when(evaluated, c("primary_reason")),
        "rule_triggered_rules": F.when(evaluated, F.array("primary_reason")), "rule_version": F.when(evaluated, RULE_VERSION), "rule_features": F.when(evaluated, features), "final_decision": final(c("final_decision")), "decision_source": final(c("decision_source")),
        "duplicate_rank_source": F.when(ranked.isNotNull(), "rf"), "selected_final": F.when(c("final_decision") == "GOOD", c("selected")), "diagnostic_message": F.coalesce(*_errors(rows), F.lit("")),
    })
    return _filled(d, RULE_COLUMNS)


def _clusters(rows: DataFrame, root: str, score: str) -> None:
    """Members of near-frequency clusters of two or more, kept or dropped, as a list and as a report; they
    are few of a run's rows and are written one after the other."""
    if "cluster_index" not in rows.columns:
        rows = rows.withColumns({"cluster_index": F.lit(None).cast("int"), "type_index": F.lit(None).cast("int")})
    kept = F.when(F.col("selected"), "KEEP").otherwise("DROP")
    value = F.col(score) if score in rows.columns else F.lit(None).cast("double")
    d = rows.where("cluster_index is not null").select("shot", "ntor", "cluster_index", F.col("type_index").alias("type_group"), "path", "omega", kept.alias("action"), value.alias("score"))
    large = d.groupBy("shot", "ntor", "cluster_index").count().where("count > 1").drop("count")
    d = d.join(large, ["shot", "ntor", "cluster_index"]).orderBy("shot", "ntor", "cluster_index", "type_group", "omega", "path")
    sinks.write_rows(f"{root}/frequency_clusters.csv", ["shot", *CLUSTER_COLUMNS], d.toLocalIterator())
    lines, last = ["Clusters of modes of near frequency"], None
    for r in d.toLocalIterator():
        if last != (r.shot, r.ntor, r.cluster_index):
            last = (r.shot, r.ntor, r.cluster_index)
            lines.append(f"\n{r.shot} n={r.ntor} cluster={r.cluster_index}")
        lines.append(f"  type {r.type_group} [{r.action}] {r.path} omega={r.omega:.6g}" + (f" score={r.score:.6f}" if r.score is not None else ""))
    sinks.write_text(f"{root}/frequency_cluster_report.txt", "\n".join(lines) + "\n")


def _summaries(root: str, found: DataFrame, settings: dict) -> None:
    """A summary by shot in both layouts and by n; ``found`` has n NULL in a shot's own row."""
    own = [r.asDict() | settings for r in found.where("n is null").orderBy("shot").collect()]
    fields = [k for k in (own[0] if own else {"shot": None}) if k != "n"]
    sinks.write_vertical({k: v for k, v in own[0].items() if k != "n"} if len(own) == 1 else {r["shot"]: r["n_total_files"] for r in own}, os.path.join(root, "shot_summary.csv"))
    sinks.write_rows(os.path.join(root, "shot_summary_wide.csv"), fields, own)
    by_n = (r.asDict() | settings for r in found.where("n is not null").orderBy("shot", "n").toLocalIterator())
    sinks.write_rows(os.path.join(root, "shot_summary_by_n.csv"), ["shot", "n", *(k for k in fields if k != "shot")], by_n)


def write_preprocess(rows: DataFrame, root: str) -> dict[str, int]:
    """The three lists of ``preprocess``."""
    c = F.col
    d = rows.withColumns({"rule_decision": F.lit(None).cast("string"), "primary_reason": F.lit(None).cast("string"), "final_decision": F.lit(None).cast("string"), "decision_source": F.lit(None).cast("string"), "selected": F.lit(None).cast("boolean"), "crossings": F.lit(None).cast("string")})
    d = rule_rows(d).withColumns({k: F.lit(None).cast("string") for k in ("rule_triggered_rules", "rule_version", "rule_features")})
    routes = {"tae_like_all": c("gap_region").isin("tae_like", "mixed"), "eae_like": c("gap_region") == "eae_like", "rejected_modes": c("rejection_reason") != ""}
    return sinks.fan_out(d, root, routes, RULE_COLUMNS, ["shot", "n", "omega", "path"])


def write_mixed(rows: DataFrame, root: str, by_executors: bool = False) -> dict[str, int]:
    """A mixed run's eight lists, its summaries, and its clusters."""
    c = F.col
    d, scored = mixed_rows(rows), c("status") == "scored"
    good = scored & (c("final_label") == "good")
    routes = {
        "all_modes_scored": F.lit(True), "tae_like_all": c("gap_region").isin("tae_like", "mixed"), "good_tae_unchecked": good, "good_tae_final": good & c("selected_final"), "bad_tae_like": scored & (c("final_label") == "bad"),
        "flagged_tae_like": scored & (F.startswith("tier", F.lit("flagged_")) | c("model_disagreement") | c("near_threshold") | c("large_score_gap")), "eae_like": c("status") == "eae_like", "rejected_modes": c("status") == "rejected",
    }
    counts = sinks.fan_out(d, root, routes, MIXED_COLUMNS, ["n", "ntor", "omega", "path"], by_executors)
    _summaries(root, S.summary(rows, ["shot", "expected_n"]).withColumnRenamed("expected_n", "n"), {})
    _clusters(rows, root, "p_avg")
    return counts


def write_rules(rows: DataFrame, root: str, overrides: DataFrame | None = None, cfg: gates.GateConfig = gates.GateConfig(), by_executors: bool = False) -> dict[str, int]:
    """A rule run's ten lists, its summaries with the run's thresholds, its clusters and the overrides given."""
    c = F.col
    # By shot, n, frequency (what is not finite last), then the file's own name, not its path, and the key.
    ntor, omega = F.when(c("ntor") != 0, c("ntor")), F.when(F.abs("omega") < float("inf"), c("omega"))
    d = rule_rows(rows).withColumns({"rules__n": F.coalesce(ntor, "n"), "rules__omega": omega, "rules__file": F.substring_index("path", "/", -1), "rules__key": F.coalesce("mode_key", "path")})
    routes = {
        "all_modes_rules": F.lit(True), "tae_like_all": c("gap_region").isin("tae_like", "mixed"), "eae_like": c("processing_status") == "ROUTED_EAE", "rejected_modes": c("final_decision") == "INVALID", "rule_results": c("rule_version").isNotNull(),
        "final_classifications": c("processing_status") != "ROUTED_EAE", "bad_tae_like": c("final_decision") == "BAD", "review_tae_like": c("final_decision") == "REVIEW", "good_tae_unchecked": c("final_decision") == "GOOD", "good_tae_final": (c("final_decision") == "GOOD") & c("selected_final"),
    }
    counts = sinks.fan_out(d, root, routes, RULE_COLUMNS, RULE_ORDER, by_executors)
    given = overrides.where(F.trim(F.coalesce("manual_decision", F.lit(""))) != "") if overrides is not None else None
    lost = given.join(rows.select("mode_key"), "mode_key", "left_anti").select(F.get(F.split("mode_key", "/"), F.lit(0)).alias("shot"), "mode_key") if given is not None else None
    settings = {"n_manual_override_rows": overrides.count(), "n_modes_manually_inspected": given.count()} if overrides is not None else {"n_manual_override_rows": 0, "n_modes_manually_inspected": 0}
    settings |= {"rule_set_version": RULE_VERSION, "duplicate_processing_status": "PROCESSED" if "cluster_index" in rows.columns else "NOT_SCORED", **asdict(cfg)}
    _summaries(root, S.rule_summary(rows.withColumn("selected", F.coalesce("selected", F.lit(False))), lost), settings)
    _clusters(rows, root, "duplicate_rank_score")
    told = _filled(overrides, files.OVERRIDE_COLUMNS) if overrides is not None else rows.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in files.OVERRIDE_COLUMNS))
    sinks.write_csv(told, f"{root}/manual_overrides.csv", files.OVERRIDE_COLUMNS, ["mode_key"])
    return counts


def leave_one_out(df: DataFrame, shots: list[str] | None = None, label: str = "y", **forest) -> DataFrame:
    """For each shot a forest trained on the others, scored on it; metrics come from the summed counts.
    The loop is over shots, of which there are few; each step is a distributed fit."""
    every = [r[0] for r in df.select("shot").distinct().orderBy("shot").collect()]
    chosen = shots or every
    if unknown := set(chosen) - set(every):
        raise ValueError(f"unknown shots {sorted(unknown)}")
    out = None
    for s in chosen:
        model = ml.train_forest(df.where(F.col("shot") != s), label, **forest)
        part = ml.score_forest(model, df.where(F.col("shot") == s)).withColumn("predicted", (F.col("p_rf") >= 0.5).cast("int"))
        out = part if out is None else out.unionByName(part)
    return out


def audit(spark: SparkSession, training_root: str, reference_root: str, labels: str, out: str | None = None, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manifest and summary of two trees against a label list; written as CSV with checksums if asked."""

    def tree(root: str) -> DataFrame:
        d = files.listing(spark, root, "*").where("file like 'egn%' or file like 'datcon%'")
        kind = F.when(F.col("file").startswith("egn"), "mode").when(F.col("file") == "datcon_gf.txt", "datcon_gf").when(F.col("file").endswith("_old"), "datcon_backup").otherwise("datcon")
        return d.select(F.concat_ws("/", "shot", F.concat(F.lit("N"), "expected_n"), "file").alias("path"), "shot", kind.alias("file_kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    theirs = tree(reference_root)
    ours = tree(training_root)
    # A backup is compared with the reference's current file of the group.
    stands_for = theirs.where("file_kind = 'datcon'").withColumn("path", F.concat("path", F.lit("_old"))).withColumn("file_kind", F.lit("datcon_backup")).join(ours.where("file_kind = 'datcon_backup'").select("path"), "path", "left_semi")
    listed = files.read_training(spark, labels)
    rows = R.manifest(ours, theirs.where("file_kind <> 'datcon_backup'").unionByName(stands_for), listed)
    rows = rows.join(listed.select("shot").distinct(), "shot", "left_semi")
    summary = R.provenance_summary(rows)
    if out is not None:
        if os.path.exists(out) and os.listdir(out) and not replace:
            raise FileExistsError(out)
        import hashlib

        names = {"manifest.csv": (rows, ["shot", "path"]), "differences.csv": (rows.where("status <> 'identical'"), ["shot", "path"]), "summary.csv": (summary, ["shot"])}
        for name, (d, order) in names.items():
            sinks.write_csv(d, f"{out}/{name}", d.columns, order)
        counts = {r.status: r["count"] for r in rows.groupBy("status").count().collect()}
        listed_modes = rows.where("in_training_csv and file_kind = 'mode'")
        modes = lambda root: files.read_modes(spark, root).withColumn("path", F.concat_ws("/", "shot", F.concat(F.lit("N"), "expected_n"), "file"))
        changed = R.changed_by_shot(listed_modes.where("status = 'different'"), modes(training_root), modes(reference_root))
        sinks.write_csv(changed, f"{out}/mode_diagnostics.csv", changed.columns, ["shot"])
        sinks.write_text(f"{out}/report.md", _audit_report(rows, summary, listed_modes, changed, counts))
        sinks.write_text(f"{out}/run_metadata.json", sinks.stable_json({"counts": counts, "training_root": training_root, "reference_root": reference_root}) + "\n")
        sums = "".join(f"{hashlib.sha256(open(f'{out}/{n}', 'rb').read()).hexdigest()}  {n}\n" for n in sorted(os.listdir(out)) if n != "SHA256SUMS")
        sinks.write_text(f"{out}/SHA256SUMS", sums)
    return rows, summary


def _table(rows: list, columns: list[str]) -> list[str]:
    number = lambda v: f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(number(r[c]) for c in columns) + " |" for r in rows)]


def _audit_report(rows: DataFrame, summary: DataFrame, listed: DataFrame, changed: DataFrame, counts: dict[str, int]) -> str:
    """What an audit found, a row a shot in each table; shots are few."""
    by_shot = lambda d: d.groupBy("shot").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "different").alias("different")).orderBy("shot").collect()
    told = lambda d: ", ".join(f"{r.shot} ({r.files})" for r in by_shot(d)) or "none"
    old = ", ".join(f"{r.shot} ({r.files}, of which {r.different} differ from the reference's current file)" for r in by_shot(rows.where("file_kind = 'datcon_backup'"))) or "none"
    lines = ["# Provenance", "", *(f"- {k}: {v}" for k, v in sorted(counts.items())), "", "## Shots", "", *_table(summary.orderBy("shot").collect(), summary.columns), "", "## Differences", ""]
    lines += [f"- Listed modes that differ: {told(listed.where("status = 'different'"))}", f"- Listed modes that the reference lacks: {told(listed.where("status = 'training_only'"))}"]
    lines += [f"- Boundary files that differ: {told(rows.where("file_kind = 'datcon' and status = 'different'"))}", f"- Kept backups of boundary files: {old}"]
    if found := changed.orderBy("shot").collect():
        lines += ["", "## Changed modes", "", *_table(found, changed.columns)]
    lines += ["", "Files are identical if their SHA-256 are. Backups are held against the reference's current file of their group."]
    return "\n".join(lines) + "\n"


def merge_labels(lists: list[DataFrame]) -> DataFrame:
    """Label lists in order: the last label of a path wins, paths keep the order of first appearance."""
    out = None
    for k, d in enumerate(lists):
        part = d.withColumn("seq", F.struct(F.lit(k).alias("list"), F.col("seq").alias("row")))
        out = part if out is None else out.unionByName(part)
    return R.last_wins(out, "path", "label", "seq")


def resolved(path, root: str | None = None):
    """An absolute path without empty, ``.`` and ``..`` parts; others are below root (NULL without one)."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit((root or "").rstrip("/") + "/"), path) if root else F.lit(None).cast("string"))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.when(whole.isNotNull(), F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")))


def below(rows: DataFrame, directories: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is one of directories(path) or below it: each path's own folders meet the list in one
    equi-join, so the list may be of any size and no row is held against patterns."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    known = directories.select(F.coalesce(F.nullif(F.rtrim(F.col("path"), F.lit("/")), F.lit("")), F.lit("")).alias("below__folder")).distinct()
    hits = rows.select(path, F.explode(folders).alias("below__folder")).join(known, "below__folder", "left_semi").select(path).distinct()
    return rows.join(hits, path, "left_semi")


def adjudication_candidates(rows: DataFrame, scope: str = "review", directories: DataFrame | None = None, root: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Rows of a rule run to adjudicate, in the order of its lists: those decided REVIEW (scope ``all``: GOOD
    and BAD too), below the directories, and not done. A path that can't be resolved, a key that is not its
    path's, and a repeated key are errors."""
    c = F.col
    if scope not in ("review", "all"):
        raise ValueError("scope is review or all")
    if lacks := {"path", "mode_key", "input_fingerprint", "ntor", "omega", "rule_decision"} - set(rows.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(lacks))}")
    said = F.upper(F.trim("rule_decision"))
    d = rows.where(said.isin(*(R.DECISIONS if scope == "all" else ("REVIEW",)))).withColumn("path", resolved(c("path"), root))
    if not d.where("path is null").isEmpty():
        raise ValueError("a relative path needs a root")
    d = below(d, directories) if directories is not None else d
    wrong = d.where(~F.trim("mode_key").eqNullSafe(R.mode_key(c("path")))).select("mode_key", "path").first()
    if wrong is not None:
        raise ValueError(f"mode_key {wrong.mode_key!r} is not that of {wrong.path!r}")
    if not d.groupBy("mode_key").count().where("count > 1").isEmpty():
        raise ValueError("mode_key is not unique among the candidates")
    d = d.join(done.select("mode_key"), "mode_key", "left_anti") if done is not None else d
    number = F.coalesce(F.when(c("ntor") != 0, c("ntor")), c("n") if "n" in rows.columns else F.lit(None).cast("int"))
    order = [F.split("mode_key", "/")[0], number.asc_nulls_last(), F.when(F.abs("omega") < float("inf"), c("omega")).asc_nulls_last(), F.substring_index("path", "/", -1), c("mode_key")]
    return d.orderBy(*order)
