import random

import corpus_pipeline
from modesift.llm.common import Scratch, components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.comp for r in components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert found == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow().to_pandas(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert 150 <= sizes[1] <= sizes[0] <= 200 and sizes[2] == sizes[1]
    assert not [r for r in docs.collect() if "@mail" in r.text]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_run_takes_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "you idiot moron", "en", None, 15), (4, "x" * 50_000, "en", "s", 50_000), *[(5, "one two three four five six", "en", "s", 27)] * 3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 2, 4, 5, None}
