import csv
import io
import random

import pytest

from modesift.sources import files


def written(rows, **style):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", **style).writerows(rows)
    return out.getvalue()


def random_rows(n, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(['"', ",", "\n", "a", "b ", "#", '""', ""]) for _ in range(rng.randrange(6)))
    return [[f"s/N1/egn{k}", cell(), cell()] for k in range(n)]


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 256 bytes, so that most records with line breaks lie across a border."""
    names = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_records_equal_the_csv_module_at_any_cut(spark, tmp_path, small_blocks):
    p = tmp_path / "a.csv"
    for seed in range(2):
        text = written(random_rows(60, seed))
        p.write_text(text)
        d = files._records(spark, str(p))
        got = [files._cells(r.value) for r in d.orderBy("seq").collect()]
        assert got == [r for r in csv.reader(io.StringIO(text)) if r]
    assert spark.read.text(str(p)).rdd.getNumPartitions() > 2


def test_quotes_within_plain_cells_open_nothing(spark, tmp_path):
    text = 'a"b,c\n"d"e",f\n"g""\nh",i\n,"j\n,k"\n' + "x," * 30000 + '"l\nm"\n'
    p = tmp_path / "a.csv"
    p.write_text(text)
    got = [files._cells(r.value) for r in files._records(spark, str(p)).orderBy("seq").collect()]
    assert got == list(csv.reader(io.StringIO(text)))


def test_wide_and_strict_cells(spark, tmp_path, small_blocks):
    rows = random_rows(60, 7)
    p = tmp_path / "a.csv"
    p.write_text(written([["path", "note", "more"], *rows], quoting=csv.QUOTE_ALL))
    got = sorted(tuple(r) for r in files.read_wide(spark, str(p)).collect())
    assert got == sorted(tuple(c.strip() for c in r) for r in rows)
    strict = files.read_strict(spark, str(p))
    assert strict.columns == ["path", "note", "more"]
    assert [r.path for r in strict.collect()] == [r[0] for r in rows]
    assert [r.note or "" for r in strict.collect()] == [r[1] for r in rows]
    p.write_text(written([["path", "note"], ["s/N1/a", "b", "c"]]))
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_strict(spark, str(p)).collect()


def test_labels_by_record(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('# a note\nnote,path,validity\n"two\nlines",s/N1/egn1,good\n\n# more\n,s/N1/egn2,bad\n')
    assert [(r.path, r.label) for r in files.read_labels(spark, str(p)).orderBy("seq").collect()] == [("s/N1/egn1", "good"), ("s/N1/egn2", "bad")]


def test_open_and_empty_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,"b\nc\n')
    with pytest.raises(ValueError, match="within quotes"):
        files._records(spark, str(p))
    p.write_text("\n\n")
    assert not files._records(spark, str(p)).collect()
    with pytest.raises(ValueError):
        files.read_strict(spark, str(p))
