"""Odd input for every operator that takes documents: clashing columns, repeated and null ids, long texts, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modesift.llm import op2_pii, op3_pack, op4_toxicity, op5_quality, op6_ctw, op7_jaccard, op9_mix

NAMES = "f_max f_sum h h2 p2 size source_size target copies copy docs need edge taken key word string times stats n node comp class terms term kind score fit q k m place bits cluster draw words batch".split()
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(NAMES)))


def odd(spark):
    rows = [(1, None, None, None, None)] * 2 + [(None, "a b you idiot", "en", "s", 3), (2, "", "en", "s", 0), (3, "you idiot moron. mail a.b@c.de", "en", None, 15)]
    rows += [(5, "one two three four five six", "en", "s", 27)] * 3 + [(6, "w " * 300_000, "en", "s", 600_000), (7, "x" * 2_200_000, "en", "s", 9)]
    return rows


def labels(spark):
    return spark.createDataFrame([(3, 0, 1), (5, 1, 0), (5, 0, 0), (1, 1, 0), (6, 1, 0), (None, 1, 1)], LABELS)


def run(spark, docs, name):
    if name == "op2":
        return op2_pii.sanitise(docs)
    if name == "op4":
        return op4_toxicity.score(docs, *op4_toxicity.train(docs, labels(spark)))
    if name == "op5":
        return op5_quality.classify(docs, labels(spark), F.col("source"), F.col("lang"))
    if name == "op7":
        return op7_jaccard.keep_one(docs, width=5, num=80, den=100)
    if name == "op9":
        return op9_mix.mix(docs)
    if name == "op3":
        return op3_pack.pack(docs)
    return op6_ctw.score(docs.withColumn("held_out", F.col("doc_id") == 2))


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op9"])
def test_odd_rows_and_clashing_columns(spark, name):
    rows = odd(spark)
    out = run(spark, documents(spark, rows), name).toArrow().to_pylist()
    ids = [r["doc_id"] for r in out]
    assert set(ids) == {r[0] for r in rows}
    if name not in ("op3", "op6", "op7"):
        assert len(out) == len(rows)
    if name == "op7":  # one of each group of copies, an id once
        assert ids.count(5) == ids.count(1) == 1
    if name not in ("op3", "op6"):
        assert all(r[c] == k for r in out for k, c in enumerate(NAMES))


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op9"])
def test_empty_tables(spark, name):
    assert run(spark, documents(spark, []), name).count() == 0


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline(spark, tmp_path, rows):
    found = odd(spark) if rows else []
    documents(spark, found).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).where(F.lit(bool(rows))).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in found}
