"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from larkspan.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    rows, cols = df.collect(), sorted(df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    at = list(found.columns)
    assert sorted(at) == cols
    expected = found.fetchall()
    mine = sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
    assert mine == sorted((tuple(r[at.index(c)] for c in cols) for r in expected), key=repr)
