"""Stage tables, runs taken up again, and the leave-one-out driver."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from modesift.operators import scoring as S
from modesift.plans import folds, runs
from modesift.sources.tables import MANIFEST, RunTables

from .test_runs import tree  # noqa: F401


def test_stages_are_made_once(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.createDataFrame([(k, None if k else "x", [1.5]) for k in range(n)], "a long, b string, c array<double>")

    t = RunTables(spark, f"file://{tmp_path}/run", "s1")
    first = t.stage("one", lambda: build(3))
    assert t.has("one") and not t.has("two")
    again = RunTables(spark, f"file://{tmp_path}/run", "s1")
    second = again.stage("one", lambda: build(5))
    assert calls == [3] and second.schema == first.schema and second.count() == 3 and again.read("one").count() == 3
    with pytest.raises(ValueError, match="other settings"):
        RunTables(spark, f"file://{tmp_path}/run", "s2").stage("one", lambda: build(5))
    # Parts without a manifest are a stage that never ended: it is made again as a whole.
    (tmp_path / "run/one" / MANIFEST).unlink()
    assert not again.has("one") and again.stage("one", lambda: build(7)).count() == 7 and calls == [3, 7]
    with pytest.raises(KeyError):
        again.read("two")
    with pytest.raises(RuntimeError):
        again.stage("two", lambda: (_ for _ in ()).throw(RuntimeError("killed")))
    assert not again.has("two")
    again.drop("one")
    assert not again.has("one")
    again.stage("three", lambda: build(1))
    again.drop()
    assert not (tmp_path / "run").exists()


def test_a_rule_run_goes_on_after_its_last_table(spark, tree, tmp_path, monkeypatch):  # noqa: F811
    df = runs.load(spark, tree)
    keys = [r.mode_key for r in df.where("file <> 'egn_bad'").select("mode_key").collect()]
    prints = {r.mode_key: r.input_fingerprint for r in df.select("mode_key", "input_fingerprint").collect()}
    over = spark.createDataFrame([(k, prints[k], "GOOD", "seen") for k in keys], "mode_key string, input_fingerprint string, manual_decision string, manual_reason string")

    def broken(d):
        raise RuntimeError("scorer not there")

    score = lambda d: d.withColumn("score", F.when(F.col("file") == "egn_a", 0.9).when(F.col("file") == "egn_b", 0.2))
    root = f"file://{tmp_path}/tables"
    with pytest.raises(RuntimeError):
        runs.sort_rules(df, over, score=broken, tables=RunTables(spark, root))
    monkeypatch.setattr(runs.gates, "evaluate", broken)  # what is decided is not decided again
    tables = RunTables(spark, root)
    rows = runs.sort_rules(df, over, score=score, tables=tables)
    assert "decided" not in tables.made and "scored" in tables.made
    # egn_a and egn_b are near; egn_c is near too and has no score, so the cluster keeps all.
    assert {r.file: r.selected for r in rows.where("shot = 's1'").collect()} == {"egn_a": True, "egn_b": True, "egn_c": True, "egn_bad": False}
    assert not [f for f in rows.schema.fields if f.name in ("mode", "low2", "high2")]
    counts = runs.write_rules(rows.withColumn("path", F.concat(F.lit("x/"), F.when(F.col("file") == "egn_a", "z/").otherwise("a/"), "file")), str(tmp_path / "out"), over)
    assert counts["good_tae_final"] == 6
    names = [r["path"].rsplit("/", 1)[1] for r in csv.DictReader(open(tmp_path / "out/good_tae_final.csv", newline="")) if r["shot"] == "s1"]
    assert names == ["egn_a", "egn_b", "egn_c"]


def test_rule_rows_go_by_frequency_then_file_name(spark, tree, tmp_path):  # noqa: F811
    rows = runs.sort_rules(runs.load(spark, tree)).withColumn("omega", F.when(F.col("file") == "egn_c", float("inf")).otherwise(F.lit(1.0)))
    rows = rows.withColumn("path", F.concat(F.when(F.col("file") == "egn_a", "z/").otherwise("a/"), "file"))
    runs.write_rules(rows, str(tmp_path))
    got = [(r["shot"], r["path"]) for r in csv.DictReader(open(tmp_path / "all_modes_rules.csv", newline=""))]
    assert [p for s, p in got if s == "s1"] == ["z/egn_a", "a/egn_b", "a/egn_bad", "a/egn_c"]


def fold_rows(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", f"s/{i % 3}", [None, 0, 1][1 + i % 2] if i % 17 else None, [float(i % 2) + float(rng.normal() * 0.3), float(rng.normal())]) for i in range(n)]
    return spark.createDataFrame(rows, "path string, shot string, y int, features array<double>"), rows


def test_leave_one_out_goes_on_and_totals_agree(spark, tmp_path):
    df, rows = fold_rows(spark)
    trained = []

    def fit(name, fails=()):
        def train(d):
            held_out = {"s/0", "s/1", "s/2"} - {r[0] for r in d.select("shot").distinct().collect()}
            trained.append((*held_out, name))
            if held_out & set(fails):
                raise RuntimeError("lost")
            return d.where("y = 1").agg(F.avg(F.col("features")[0])).first()[0] / 2

        return folds.Model(name, train, lambda m, d: d.withColumn("p", F.when(F.col("path") != "p5", F.when(F.col("features")[0] > m, 0.8).otherwise(0.1))))

    def driver(fails=(), **args):
        return folds.LeaveOneOut(df, [fit("A", fails), fit("B")], RunTables(spark, f"file://{tmp_path}/folds"), **args)

    assert all(not r["done"] and r["train"]["n_rows"] == 80 for r in driver().ledger()) and len(driver().ledger()) == 6 and not trained
    with pytest.raises(folds.FoldError, match="s/1/A: RuntimeError: lost") as e:
        driver(["s/1"]).run(side_by_side=3)
    assert set(e.value.failed) == {("s/1", "A")} and len(trained) == 6
    half = driver()
    assert half.missing() == [("s/1", "A")] and [r["done"] for r in half.ledger()].count(True) == 5
    half.write(str(tmp_path / "half"))
    assert [r["shot"] for r in csv.DictReader(open(tmp_path / "half/loso_missing_outputs.csv", newline=""))] == ["s/1"]
    trained.clear()
    assert driver().run() == [("s/1", "A")] and trained == [("s/1", "A")] and driver().run() == []
    whole = driver()
    whole.write(str(tmp_path / "out"))
    assert not (tmp_path / "out/loso_missing_outputs.csv").exists()
    totals = {r["model"]: r for r in csv.DictReader(open(tmp_path / "out/loso_model_evaluation_totals.csv", newline=""))}
    summary = list(csv.DictReader(open(tmp_path / "out/loso_model_evaluation_summary.csv", newline="")))
    assert list(summary[0]) == folds.SUMMARY_COLUMNS and list(totals["A"]) == folds.TOTAL_COLUMNS and len(summary) == 6
    labelled = [r for r in rows if r[2] is not None and r[0] != "p5"]
    want = S.metrics(S.confusion(whole.scored().where("y is not null and p is not null"), "y", "predicted", ["model"])).collect()
    for r in want:
        t = totals[r.model]
        assert int(t["n_matched"]) == r.n_matched == len(labelled) and int(t["tp_good"]) == r.tp_good and float(t["f1_good"]) == pytest.approx(r.f1_good) and t["n_folds"] == "3"
    one = next(r for r in summary if r["shot"] == "s/2" and r["model"] == "B")
    assert int(one["n_train"]) == 80 and int(one["n_test"]) == 40 and int(one["n_test_good"]) == sum(r[2] == 1 for r in rows if r[1] == "s/2")
    with pytest.raises(ValueError, match="unknown shots"):
        driver(shots=["other"])
    assert driver(shots=["s/0"]).shots == ["s/0"]


def test_leave_one_out_of_a_forest_equals_the_loop(spark, tmp_path):
    df, _ = fold_rows(spark, 60)
    run = folds.LeaveOneOut(df, [folds.forest(trees=5, depth=3)], RunTables(spark, f"file://{tmp_path}/folds"))
    run.run()
    loop = {r.path: r.p_rf for r in runs.leave_one_out(df, trees=5, depth=3).collect()}
    got = {r.path: r.p for r in run.scored().collect()}
    assert set(got) == set(loop) and run.summary().where("accuracy > 0.7").count() == 3
