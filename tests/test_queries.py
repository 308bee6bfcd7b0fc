import os

import duckdb
import pandas as pd
import pytest

from modesift import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    plain = df.astype(object).where(df.notna(), None)
    return sorted(map(str, ([int(v) if isinstance(v, float) and v == int(v) else v for v in r] for r in plain.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    found = Q.QUERIES[name](spark, SF)
    cols = sorted(found.columns)
    got = found.select(cols).toArrow().to_pandas()
    if name not in Q.ORACLES:
        assert len(got)
        return
    want = duck.execute(Q.ORACLES[name]).df()
    assert sorted(want.columns) == cols
    assert rows(got) == rows(pd.DataFrame(want[cols]))
