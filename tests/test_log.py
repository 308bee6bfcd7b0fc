"""The append log, and candidates of an adjudication."""

import pytest
from pyspark.sql import functions as F

from modesift.plans import runs
from modesift.sources.log import AppendLog
from modesift.streaming import watch


def held(log):
    return sorted((r.key, r.value, r.log_seq) for r in log.read().collect())


def test_batches_count_once_and_compaction_changes_nothing(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value int")
    assert log.read() is None and log.latest("key") is None
    assert log.append(rows(("a", 1), ("b", 2)), "b1") and log.append(rows(("a", 3), ("a", 4)).coalesce(1), "b2")
    assert not log.append(rows(("a", 9)), "b1") and held(log) == [("a", 1, 1), ("a", 3, 2), ("a", 4, 2), ("b", 2, 1)]
    assert {r.key: r.value for r in log.latest("key").collect()} == {"a": 4, "b": 2}
    # Parts that were written but never committed are not there.
    rows(("z", 0)).withColumn("log_pos", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/log/data/lost")
    before = held(log)
    log.compact()
    assert held(log) == before and not log.append(rows(("a", 9)), "b2") and len(log._commits()) == 1
    assert log.append(spark.createDataFrame([("c", 5, "new")], "key string, value int, more string"), "b3")
    assert held(log) == sorted([*before, ("c", 5, 4)]) and {r.key: r.value for r in log.latest("key").collect()} == {"a": 4, "b": 2, "c": 5}
    log.compact()
    log.compact()
    assert {r.key: r.more for r in log.read().collect()}["c"] == "new" and len(log._commits()) == 1


def test_a_number_is_committed_by_one_writer(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log")
    told = {"parts": [], "batches": ["x"], "schema": {"type": "struct", "fields": []}, "compacted": False}
    assert log._commit(1, told) and not log._commit(1, told)


def test_a_stream_run_again_adds_nothing(spark, tmp_path):
    spark.createDataFrame([(i, i * 2) for i in range(20)], "key int, value int").write.parquet(str(tmp_path / "in"))
    log = AppendLog(spark, f"file://{tmp_path}/log")
    stream = lambda: spark.readStream.schema("key int, value int").parquet(str(tmp_path / "in"))
    watch.append_once(stream(), log, "q", str(tmp_path / "ck1")).awaitTermination(120)
    assert log.read().count() == 20
    watch.append_once(stream(), log, "q", str(tmp_path / "ck2")).awaitTermination(120)  # its checkpoint was lost
    assert log.read().count() == 20


def candidates(spark, rows):
    return spark.createDataFrame([(p, k, "f" * 64, n, w, d) for p, k, n, w, d in rows], "path string, mode_key string, input_fingerprint string, ntor int, omega double, rule_decision string")


def test_candidates_by_scope_directory_and_order(spark):
    rows = [
        ("/d/s1/N1/b", "s1/N1/b", 1, 1.0, "REVIEW"), ("/d/s1/N1/a", "s1/N1/a", 1, 1.0, " review "), ("s1/../s1/N2/c", "s1/N2/c", 2, 0.5, "REVIEW"), ("/d/s10/N1/d", "s10/N1/d", 1, None, "REVIEW"),
        ("/d/s1/N1/e", "s1/N1/e", 1, 0.1, "GOOD"), ("/d/s1/N1/f", "s1/N1/f", 1, 0.2, "INVALID"), ("/other/s1/N1/g", "s1/N1/g", 1, 0.2, "REVIEW"),
    ]
    df = candidates(spark, rows)
    keys = lambda **a: [r.mode_key for r in runs.adjudication_candidates(df, root="/d", **a).collect()]
    folder = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert keys(directories=folder("/d/")) == ["s1/N1/a", "s1/N1/b", "s1/N2/c", "s10/N1/d"]
    assert keys(directories=folder("/d/s1")) == ["s1/N1/a", "s1/N1/b", "s1/N2/c"]  # s10 is not below s1
    assert keys(directories=folder("/d/s1/N2", "/d/s10", "/none"), scope="all") == ["s1/N2/c", "s10/N1/d"]
    assert "s1/N1/e" in keys(scope="all") and "s1/N1/f" not in keys(scope="all") and len(keys(directories=folder("/"))) == 5
    assert keys(directories=folder("/d/s1"), done=spark.createDataFrame([("s1/N1/a",)], "mode_key string")) == ["s1/N1/b", "s1/N2/c"]
    assert runs.adjudication_candidates(df.where("mode_key = 's1/N2/c'"), root="/d/").first().path == "/d/s1/N2/c"
    with pytest.raises(ValueError, match="root"):
        runs.adjudication_candidates(df)
    with pytest.raises(ValueError, match="is not that of"):
        runs.adjudication_candidates(candidates(spark, [("/d/s1/N1/a", "s1/N1/b", 1, 1.0, "REVIEW")]))
    with pytest.raises(ValueError, match="unique"):
        runs.adjudication_candidates(candidates(spark, [rows[0], ("/e/s1/N1/b", "s1/N1/b", 1, 1.0, "REVIEW")]))
    with pytest.raises(ValueError, match="missing columns"):
        runs.adjudication_candidates(df.drop("ntor"))
    with pytest.raises(ValueError, match="scope"):
        runs.adjudication_candidates(df, scope="some")
