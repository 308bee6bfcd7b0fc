import numpy as np
import pytest
from pyspark.sql import functions as F

from modesift.functions import cnn as C
from modesift.operators import dedup, ml
from modesift.operators import features as X
from modesift.operators import relational as R
from modesift.operators import scoring as S
from modesift.plans import runs
from modesift.sources import files, sinks
from modesift.streaming import watch


def default_mode(ntor=1, nr=10, at=0.4):
    r = np.linspace(0, 1, nr)
    m = np.stack([(i + 1) * np.exp(-(((r - at) / 0.18) ** 2)) for i in range(4 * ntor)])
    return m / m.max()


@pytest.fixture()
def tree(tmp_path):
    for shot in ("s1", "s2"):
        n = tmp_path / "data" / shot / "N1"
        n.mkdir(parents=True)
        for k, name in enumerate(("egn_a", "egn_b", "egn_c")):
            (n / name).write_bytes(files.encode_mode(default_mode(at=0.4 if k < 2 else 0.6), 1.0 + 0.005 * k, 0.01, 1))
        (n / "datcon1").write_text("1 10\n" + "0.25 2.25\n" * 10)
    (tmp_path / "data/s1/N1/egn_bad").write_bytes(b"x" * 41)
    return str(tmp_path / "data")


def test_sources(spark, tree):
    modes = files.read_modes(spark, tree).orderBy("path").collect()
    assert len(modes) == 7 and sum(r.load_error is not None for r in modes) == 1
    good = next(r for r in modes if r.file == "egn_b")
    assert (good.omega, good.ntor, good.nr, good.nhar) == (1.005, 1, 10, 4) and np.allclose(good.mode, default_mode())
    df = runs.preprocess(runs.load(spark, tree))
    got = {r.file: (r.rejection_reason, r.gap_region) for r in df.where("shot = 's1'").collect()}
    assert got["egn_bad"] == ("mode_load_failed", None) and got["egn_a"] == ("", "tae_like")
    with pytest.raises(ValueError):
        files.parse_continuum("1 3\n1 2\n")
    with pytest.raises(ValueError):
        files.decode_mode(np.zeros(10).tobytes())


def test_preflight(spark, tree, tmp_path):
    """A shot with an incomplete group is not run; the others are."""
    (tmp_path / "data/s2/N1/datcon1").unlink()
    with pytest.raises(FileNotFoundError, match="s2/N1"):
        runs.load(spark, tree, strict=True)
    rows = runs.sort_rules(runs.load(spark, tree)).collect()
    assert {r.rejection_reason for r in rows if r.shot == "s2"} == {"missing_continuum_group"}
    assert {r.final_decision for r in rows if r.shot == "s1"} == {"REVIEW", "INVALID"}


def test_fingerprint_of_a_run(spark, tree):
    import hashlib

    rows = runs.load(spark, tree, tag="SOME_TAG").where("shot = 's1'").collect()
    boundary = open(f"{tree}/s1/N1/datcon1", "rb").read()
    for r in rows:
        mode = open(r.path.removeprefix("file:"), "rb").read()
        want = b"SOME_TAG\0" + b"".join(name + b"\0" + len(x).to_bytes(16, "big") + x for name, x in ((b"mode", mode), (b"datcon", boundary)))
        assert r.input_fingerprint == hashlib.sha256(want).hexdigest()


def table(path):
    import csv

    return list(csv.DictReader(open(path, newline="")))


def test_mixed_run(spark, tree, tmp_path):
    df = runs.load(spark, tree)
    rf = lambda d: d.withColumn("p_rf", F.when(F.col("file") == "egn_c", 0.1).when(F.col("file") == "egn_b", 0.95).otherwise(0.9))
    cnn = lambda d: d.withColumn("p_cnn", F.when(F.col("file") == "egn_c", 0.1).otherwise(0.9))
    rows = runs.sort_mixed(df, rf, cnn)
    counts = runs.write_mixed(rows, str(tmp_path / "out"))
    assert (counts["all_modes_scored"], counts["good_tae_unchecked"], counts["good_tae_final"], counts["rejected_modes"]) == (7, 4, 2, 1)
    assert {r.file for r in rows.where("selected").collect()} == {"egn_b"}
    got = table(tmp_path / "out/all_modes_scored.csv")
    assert list(got[0]) == runs.MIXED_COLUMNS and len(runs.MIXED_COLUMNS) == 25
    # Rows that could not be read have no ntor and omega and come last in their n.
    assert got[-1]["status"] == "rejected" and got[-1]["ntor"] == "" and "ValueError" in got[-1]["error_message"]
    assert float(got[0]["rad_loc"]) == pytest.approx(0.4, abs=0.05)
    before = (tmp_path / "out/all_modes_scored.csv").read_bytes()
    runs.write_mixed(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/all_modes_scored.csv").read_bytes() == before
    clusters = table(tmp_path / "out/frequency_clusters.csv")
    assert sorted((r["shot"], r["path"][-5:], r["action"]) for r in clusters) == [(s, f, a) for s in ("s1", "s2") for f, a in (("egn_a", "DROP"), ("egn_b", "KEEP"))]
    assert "n=1 cluster=1" in (tmp_path / "out/frequency_cluster_report.txt").read_text()
    assert [r["n_final_good"] for r in table(tmp_path / "out/shot_summary_wide.csv")] == ["1", "1"]
    assert [(r["shot"], r["n"]) for r in table(tmp_path / "out/shot_summary_by_n.csv")] == [("s1", "1"), ("s2", "1")]
    assert runs.write_mixed(rows, str(tmp_path / "parts"), by_executors=True) == counts
    single = runs.sort_single(df, lambda d: d.withColumn("score", F.lit(0.7)))
    assert single.where("selected").count() == 4
    assert {r.gap_group for r in runs.split_gap(df).collect()} == {"below_upper2", None}
    assert runs.write_preprocess(runs.preprocess(df), str(tmp_path / "pre")) == {"tae_like_all": 6, "eae_like": 0, "rejected_modes": 1}


def test_rule_run_with_overrides_from_a_file(spark, tree, tmp_path):
    df = runs.load(spark, tree)
    plain = runs.sort_rules(df)
    counts = runs.write_rules(plain, str(tmp_path / "rules"))
    assert counts["review_tae_like"] == 6 and counts["good_tae_final"] == 0 and counts["rejected_modes"] == 1
    assert (tmp_path / "rules/good_tae_final.csv").read_text().count("\n") == 1  # a header all the same
    got = table(tmp_path / "rules/all_modes_rules.csv")
    assert list(got[0]) == runs.RULE_COLUMNS and len(runs.RULE_COLUMNS) == 34
    one = got[0]
    assert one["rule_triggered_rules"] == '["NO_GOOD_TEMPLATE"]' and one["processing_status"] == "RULE_EVALUATED" and len(one["input_fingerprint"]) == 64
    import json

    features = json.loads(one["rule_features"])
    assert features["boundary_features"]["axis_artifact"]["axis_peak"] is not None and features["crossing_features"]["r_star_max"] is None and features["crossing_records"] == []
    bad = next(r for r in got if r["processing_status"] == "INVALID")
    assert bad["preprocessing_primary_reason"] == "MODE_LOAD_FAILED" and bad["rule_features"] == ""
    lines = [",".join(files.OVERRIDE_COLUMNS)]
    for k, r in enumerate(x for x in got if x["rule_decision"] == "REVIEW"):
        key, mark = r["mode_key"], r["input_fingerprint"]
        stale = mark if k != 1 else "0" * 64
        lines.append(f"{key},{r['path']},{stale.upper()},1,{r['omega']},REVIEW,{'G' if k != 2 else ''},{'seen' if k != 2 else ''},me,2024-01-01")
    lines.append("gone/N1/egn,x," + "1" * 64 + ",1,1,REVIEW,B,gone,me,2024-01-01")
    (tmp_path / "o.csv").write_text("\n".join(lines) + "\n")
    over = files.read_overrides(spark, str(tmp_path / "o.csv"))
    score = lambda d: d.withColumn("score", F.when(F.col("file") == "egn_a", 0.9).otherwise(0.1))
    rows = runs.sort_rules(df, over, score=score)
    runs.write_rules(rows, str(tmp_path / "over"), over)
    got = {r["mode_key"]: r for r in table(tmp_path / "over/all_modes_rules.csv")}
    status = [r["override_status"] for r in got.values()]
    assert status.count("APPLIED") == 4 and status.count("STALE_FINGERPRINT") == 1 and status.count("NOT_PRESENT") == 1
    applied = next(r for r in got.values() if r["override_status"] == "APPLIED")
    assert (applied["final_decision"], applied["manual_decision"], applied["manual_reason"], applied["reviewer"], applied["decision_source"]) == ("GOOD", "GOOD", "seen", "me", "manual_override")
    stale = next(r for r in got.values() if r["override_status"] == "STALE_FINGERPRINT")
    assert stale["override_message"] and stale["final_decision"] == "REVIEW" and stale["reviewer"] == ""
    wide = {r["shot"]: r for r in table(tmp_path / "over/shot_summary_wide.csv")}
    assert sum(int(r["n_overrides_applied"]) for r in wide.values()) == 4 and all(r["n_manual_override_rows"] == "7" and r["n_modes_manually_inspected"] == "6" for r in wide.values())
    assert {json.loads(r["transition_counts_json"]).get("REVIEW->GOOD", 0) for r in wide.values()} <= {1, 2, 3}
    assert len(table(tmp_path / "over/manual_overrides.csv")) == 7
    assert all(r["selected_final"] in ("True", "False") for r in got.values() if r["final_decision"] == "GOOD")


def test_audit(spark, tree, tmp_path):
    import shutil

    shutil.copytree(tree, tmp_path / "ref")
    (tmp_path / "ref/s1/N1/egn_a").write_bytes(b"different")
    (tmp_path / "ref/s1/N1/egn_b").unlink()
    (tmp_path / "ref/s1/N1/datcon1").write_text("other")
    (tmp_path / "data/s1/N1/datcon1_old").write_text("other")
    (tmp_path / "labels.csv").write_text("path,validity\ns1/N1/egn_a,good\ns1/N1/egn_gone,bad\ns2/N1/egn_a,good\n")
    out = str(tmp_path / "audit")
    rows, summary = runs.audit(spark, tree, str(tmp_path / "ref"), str(tmp_path / "labels.csv"), out)
    st = {r.path: r.status for r in rows.collect()}
    assert (st["s1/N1/egn_a"], st["s1/N1/egn_b"], st["s1/N1/egn_gone"], st["s1/N1/datcon1"], st["s1/N1/datcon1_old"]) == ("different", "training_only", "missing_both", "different", "identical")
    verdict = {r.shot: r.overall_status for r in summary.collect()}
    assert verdict == {"s1": "mode_and_continuum_mismatch", "s2": "active_payload_aligned"}
    report = (tmp_path / "audit/report.md").read_text()
    assert "Listed modes that differ: s1 (1)" in report and "| s1 | 1 | 0 | 0 |  |  | 1 |" in report and "s1 (1, of which 0 differ" in report
    other = files.encode_mode(default_mode(at=0.3), 1.1, 0.01, 1)
    for shot, content in (("s1", other), ("s2", files.encode_mode(default_mode(nr=12), 1.0, 0.01, 1))):
        (tmp_path / f"ref/{shot}/N1/egn_a").write_bytes(content)
    runs.audit(spark, tree, str(tmp_path / "ref"), str(tmp_path / "labels.csv"), out, replace=True)
    found = {r["shot"]: r for r in table(tmp_path / "audit/mode_diagnostics.csv")}
    assert [found["s1"][k] for k in ("n_changed", "n_structure", "n_shape", "n_not_compared")] == ["1", "1", "0", "0"] and float(found["s1"]["max_abs_relative_omega"]) == pytest.approx(0.1)
    assert [found["s2"][k] for k in ("n_changed", "n_structure", "n_shape")] == ["1", "1", "1"]
    with pytest.raises(FileExistsError):
        runs.audit(spark, tree, str(tmp_path / "ref"), str(tmp_path / "labels.csv"), out)
    (tmp_path / "labels.csv").write_text("path,validity\n../N1/egn_a,good\n")
    with pytest.raises(ValueError):
        files.read_training(spark, str(tmp_path / "labels.csv"))


def test_lists(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("# note\n\ns/N1/egn1,good\ns/N1/egn2,bad\ns/N1/egn1,bad\n")
    a = files.read_labels(spark, str(p))
    assert [(r.path, r.label) for r in a.orderBy("seq").collect()] == [("s/N1/egn1", "good"), ("s/N1/egn2", "bad"), ("s/N1/egn1", "bad")]
    p2 = tmp_path / "b.csv"
    p2.write_text("other,path,validity\n1,s/N1/egn2,good\n")
    m = {r.path: r.label for r in runs.merge_labels([a, files.read_labels(spark, str(p2))]).collect()}
    assert m == {"s/N1/egn1": "bad", "s/N1/egn2": "good"}
    p3 = tmp_path / "c.csv"
    p3.write_text("x,x,y\n1,2,3\n4\n")
    assert files.read_wide(spark, str(p3)).columns == ["path", "col2", "col3"]
    p3.write_text("x,path,x\n1,s/N1/a,3\n4\n")
    wide = files.read_wide(spark, str(p3))
    assert wide.columns == ["x", "path", "x_2"] and [tuple(r) for r in wide.collect()] == [("1", "s/N1/a", "3"), ("4", "", "")]
    p3.write_text("# note\ns/N1/a,good,tae,7\n\ns/N1/b,Bad,eae\n")
    wide = files.read_wide(spark, str(p3))
    assert wide.columns == ["path", "validity", "family", "col4"] and wide.count() == 2
    p3.write_text("x,x,y\n1,2,3\n4\n")
    with pytest.raises(ValueError):
        files.read_strict(spark, str(p3))
    p4, head = tmp_path / "o.csv", ",".join(files.OVERRIDE_COLUMNS) + "\n"
    row = lambda mark, decision, reason: f"k,p,{mark},1,1.5,BAD,{decision},{reason},me,2024-01-01\n"
    p4.write_text(head + row("A" * 64, " g ", "why"))
    one = files.read_overrides(spark, str(p4)).first()
    assert (one.manual_decision, one.input_fingerprint) == ("GOOD", "a" * 64)
    for bad, match in ((row("short", "G", "why"), "input_fingerprint"), (row("g" * 64, "G", "why"), "input_fingerprint"), (row("a" * 64, "", "why"), "manual_decision"), (row("a" * 64, "G", ""), "manual_reason"), (row("a" * 64, "maybe", "why"), "manual_decision")):
        p4.write_text(head + bad)
        with pytest.raises(ValueError, match=match):
            files.read_overrides(spark, str(p4))


def test_overrides(spark):
    rows = spark.createDataFrame([("a", "1", "GOOD"), ("b", "2", "BAD"), ("c", "3", "REVIEW"), ("d", "4", "REVIEW"), ("e", "5", "INVALID"), ("f", "6", "BAD"), ("g", "7", "BAD")], "mode_key string, input_fingerprint string, rule_decision string")
    given = spark.createDataFrame([("a", "1", "bad"), ("b", "2", "R"), ("c", "3", "g"), ("d", "x", "g"), ("e", "5", "g"), ("f", "6", "g"), ("f", "6", "b"), ("g", "7", " ")], "mode_key string, input_fingerprint string, manual_decision string")
    got = {r.mode_key: (r.override_status, r.final_decision) for r in R.apply_overrides(rows, given).collect()}
    assert got == {"a": ("APPLIED", "BAD"), "b": ("APPLIED", "REVIEW"), "c": ("APPLIED", "GOOD"), "d": ("STALE_FINGERPRINT", "REVIEW"), "e": ("INELIGIBLE_DECISION", "INVALID"), "f": ("AMBIGUOUS_OVERRIDE", "BAD"), "g": ("NOT_PRESENT", "BAD")}


def test_fusion_tiers(spark):
    cases = [(0.7, 0.6, "gold_good"), (0.1, 0.1, "gold_bad"), (0.5, 0.5, "silver_good"), (0.4, 0.9, "flagged_cnn_rescue"), (0.3, 0.3, "silver_bad"), (0.5, 0.1, "flagged_rf_only_good"), (0.45, 0.5, "flagged_borderline_or_disagreement")]
    got = [r.tier for r in S.fuse(spark.createDataFrame([(a, b) for a, b, _ in cases], "p_rf double, p_cnn double")).collect()]
    assert got == [t for *_, t in cases]


def test_clusters_and_dedup(spark):
    m = default_mode().tolist()
    rows = [(1, "a", 1.0, 0.2, m), (1, "b", 1.015, 0.9, m), (1, "c", 1.025, 0.5, m), (1, "d", 1.018, 0.8, default_mode(at=0.7).tolist()), (2, "e", 1.0, 0.1, m)]
    df = spark.createDataFrame(rows, "ntor int, mode_id string, omega double, score double, mode array<array<double>>").repartition(5)
    c = {r.mode_id: r.cluster_index for r in R.frequency_clusters(df, ["ntor"], "omega", "mode_id").collect()}
    assert c == {"a": 1, "b": 1, "d": 1, "c": 2, "e": 1}
    kept = {r.mode_id for r in dedup.representatives(df, ["ntor"]).where("selected").collect()}
    assert kept == {"b", "d", "c", "e"}
    log = {(r.mode_id, r.against): (r.same, round(r.relative_omega, 4)) for r in dedup.comparisons(df, ["ntor"]).collect()}
    assert log[("a", "b")] == (True, 0.0148) and log[("d", "b")][0] is False and set(log) == {("d", "b"), ("a", "b")}


def test_clusters_against_a_loop(spark):
    """Dense and sparse values, ties, missing ones, and groups that end within a batch."""
    rng = np.random.default_rng(6)
    rows = [(int(g) if g else None, f"k{i}", None if i % 97 == 0 else float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 30_000), np.concatenate([rng.uniform(1, 1.5, 20_000), rng.uniform(0, 100, 9_000), np.full(1_000, 3.0)]), strict=True))]
    df = spark.createDataFrame(rows, "ntor int, mode_id string, omega double")
    got = {r.mode_id: r.cluster_index for r in R.frequency_clusters(df, ["ntor"], "omega", "mode_id").collect()}
    for g in {r[0] for r in rows}:
        index, anchor = 0, None
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            if anchor is None or v is None or not abs(v - anchor) / max(abs(anchor), 1e-12) < 0.02:
                index, anchor = index + 1, v
            assert got[k] == index


def test_forest_and_array_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        y = i % 2
        mode = (rng.normal(size=(4, 12)) * 0.1 + y * default_mode(nr=12)).tolist()
        rows.append((i, f"s{i % 3}", y, mode, 1.0, 0.01, 1, 12, 4, [0.25] * 12, [2.25] * 12))
    df = X.feature_vector(spark.createDataFrame(rows, "mode_id int, shot string, y int, mode array<array<double>>, omega double, gamma_d double, ntor int, nr int, nhar int, low2 array<double>, high2 array<double>"))
    small = df.select("mode_id", "shot", "y", "features").cache()
    model = ml.train_forest(small, trees=10, depth=5)
    ml.save_forest(model, str(tmp_path / "rf"), spark, 22)
    with pytest.raises(ValueError):
        ml.load_forest(str(tmp_path / "rf"), spark, 28)
    scored = ml.score_forest(ml.load_forest(str(tmp_path / "rf"), spark, 22), small)
    assert scored.where("(p_rf >= 0.5) = (y = 1)").count() >= 55
    with pytest.raises(ValueError):
        ml.load_forest(str(tmp_path / "rf"), spark, 22, energy_tie=True)
    dealt = ml.folds(small, "mode_id", k=3).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in dealt} == {10} and len(dealt) == 6
    assert ml.cross_validate(small, "mode_id", k=2, trees=5, depth=4).where("accuracy > 0.7").count() == 2
    tested, refitted = ml.holdout(small, "mode_id", fraction=0.2, trees=5, depth=4)
    assert tested.count() == 12 and len(ml.importances(refitted, 22)) == 22
    oof = ml.out_of_fold(small, "mode_id", k=2, trees=10, depth=5)
    assert oof.count() == 60 and oof.where("(p_oof >= 0.5) = (y = 1)").count() >= 45
    loso = runs.leave_one_out(small, trees=5, depth=4)
    assert loso.count() == 60
    assert S.metrics(S.confusion(loso, "y", "predicted")).first().accuracy > 0.8
    for kind in ("raw", "raw3", "branch", "hybrid"):
        out = ml.score_array_model(df.limit(5).select("mode_id", "mode", "omega", "gamma_d", "ntor", "low2", "high2", "delta2_eff", "W_star", "S", "r_star"), C.random_weights(kind), rows=16, cols=40)
        assert all(0 < r.p_cnn < 1 and r.p_cnn_error is None for r in out.collect()), kind


def test_scores_of_models_without_probabilities(spark):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([([float(i)], float(i >= 5)) for i in range(10)], "features array<double>, label double")
    raw = df.withColumn("raw", array_to_vector("features"))
    margin = ml.score_forest(LinearSVC(featuresCol="raw", labelCol="label").fit(raw), df, "p")
    assert all((r.p >= 0.5) == (r.label == 1) and 0 < r.p < 1 for r in margin.collect()) and margin.columns == ["features", "label", "p"]
    plain = ml.score_forest(LinearRegression(featuresCol="raw", labelCol="label").fit(raw), df, "p").collect()
    assert plain[0].p < 0.2 and plain[9].p > 0.8


def test_convolution_against_loops():
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(2, 5, 6)), rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    want = np.array([[[b[o] + (w[o] * p[:, i : i + 3, j : j + 3]).sum() for j in range(6)] for i in range(5)] for o in range(3)])
    assert np.allclose(C.conv(x, w, b), want)
    assert np.allclose(C.pool(x), x[:, :4].reshape(2, 2, 2, 3, 2).max(axis=(2, 4)))
    du, dl, ok = C.gap_channels(1.0, np.full(5, 0.64), np.full(5, 1.44), 7)
    assert np.allclose(du, 0.2) and np.allclose(dl, 0.2) and ok.all()
    du, dl, _ = C.gap_channels(1.3, np.full(5, 0.64), np.full(5, 1.44), 7)
    assert (du < 0).all() and (dl > 0).all()
    mode = np.zeros((2, 5))
    mode[0] = np.sqrt([0, 1, 0.8, 0.2, 0])
    nan = np.array([np.nan, 0.64, 0.64, 0.64, np.nan])
    b4 = C.branch(mode, 1.0, nan, nan * 2.25, 5)
    assert np.allclose(b4[0], [0, 1, 0.8, 0.2, 0], atol=1e-6) and b4[3].tolist() == [0, 1, 1, 1, 0] and np.allclose(b4[1:3, 1:4], 0.2, atol=1e-6) and (b4[1:3, 0] == 0).all()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 20, (20 - i) / 20) for i in range(20)], "id int, p_rf double, p_cnn double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = watch.scores(spark, str(tmp_path / "in"), "id int, p_rf double, p_cnn double")
    watch.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("id", "tier", "is_flagged").collect()))
    assert got == sorted(map(str, S.flagged(S.fuse(rows)).select("id", "tier", "is_flagged").collect()))


def test_average_precision_against_a_loop(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(-0.2, 1.3, 900), np.full(50, 0.5), np.full(50, 1.0)])
    y = (rng.random(1000) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)] + [(None, 1), (0.3, None)], "p double, y int")
    want, last = 0.0, 0.0
    for level in sorted(set(p), reverse=True):
        above = p >= level
        recall = y[above].sum() / y.sum()
        want += (recall - last) * y[above].mean()
        last = recall
    assert S.average_precision(df, "p", "y").first()[0] == pytest.approx(want)
    assert S.threshold_sweep(df, "p", "y").count() == len(set(p))


def test_sinks():
    assert sinks.stable_json({"b": float("nan"), "a": [1, {"d": True}]}) == '{"a":[1,{"d":true}],"b":null}'
    assert sinks.text(float("inf")) == "" and sinks.text(None) == ""


def test_keys(spark):
    d = spark.createDataFrame([("/x/shot/N3/egn1", "shot"), ("nothing", "shot")], "path string, shot string")
    r = d.select(R.mode_key(F.col("path")).alias("k"), R.shot_relative(F.col("path"), F.col("shot")).alias("s"), R.match_keys(F.col("path"), True).alias("m")).collect()
    assert (r[0].k, r[0].s, r[1].k, r[1].s) == ("shot/N3/egn1", "shot/N3/egn1", None, "nothing") and "N3/egn1" in r[0].m


def test_rule_summary_against_a_loop(spark):
    import json
    from collections import Counter

    rules, status, finals = ("BAD", "REVIEW", "INVALID"), ("APPLIED", "STALE_FINGERPRINT", "AMBIGUOUS_OVERRIDE", "INELIGIBLE_DECISION", "NOT_PRESENT"), ("GOOD", "BAD")
    rows = []
    for i in range(60):
        st = status[i % 5]
        rule = rules[i % 3]
        rows.append((f"s{i % 2}", i % 4 or None, "mixed", "mode_load_failed" if i % 7 == 0 else "", rule, ("BAD_EDGE_SPIKE", "NO_GOOD_TEMPLATE")[i % 2], st, finals[i % 4 // 2] if st == "APPLIED" else rule, i % 8 == 0))
    cols = "shot string, ntor int, gap_region string, rejection_reason string, rule_decision string, primary_reason string, override_status string, final_decision string, selected boolean"
    lost = spark.createDataFrame([("s1", "k1"), ("s1", "k2")], "shot string, key string")
    got = {(r.shot, r.n): r for r in S.rule_summary(spark.createDataFrame(rows, cols), lost).collect()}
    keys = {(r[0], n) for r in rows for n in (None, r[1])}
    assert set(got) == keys
    for shot, n in keys:
        own = [r for r in rows if r[0] == shot and (n is None or r[1] == n)]
        moved = Counter(f"{r[4]}->{r[7]}" for r in own if r[6] == "APPLIED" and r[4] != r[7])
        g = got[shot, n]
        assert json.loads(g.transition_counts_json) == moved and list(json.loads(g.transition_counts_json)) == sorted(moved)
        assert json.loads(g.primary_reason_counts_json) == Counter(r[3] or r[5] for r in own)
        assert (g.n_total_files, g.n_decisions_changed, g.n_final_good) == (len(own), sum(moved.values()), sum(r[8] for r in own))
        assert [g.n_overrides_applied, g.n_stale_overrides, g.n_ambiguous_overrides, g.n_ineligible_overrides] == [sum(r[6] == s for r in own) for s in status[:4]]
        assert g.n_unmatched_overrides == (2 if (shot, n) == ("s1", None) else 0)
