"""Every corpus query that SQL can express against its SQL on the smallest tables."""

import duckdb
import pytest

from larkspan.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    found = duck.sql(queries.oracle_sql()[name])
    at = list(found.columns)
    assert sorted(at) == cols
    expected = sorted((tuple(r[at.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == expected
