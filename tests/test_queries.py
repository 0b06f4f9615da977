import os

import duckdb
import pytest

from gridwright import file_queries, queries  # noqa: F401  (the former adds to the latter)

HOME = os.environ.get("GRIDWRIGHT_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(HOME):
        pytest.skip("no test tables")
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as select * from '{HOME}/{t}.parquet'")
    return found


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, HOME)
    got, want = df.collect(), duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    assert got
