"""Each query with SQL against DuckDB on the small tables: names, types, values."""

import duckdb
import pytest

from ravelin.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    return "%.10g" % v if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(ORACLE[name])
    theirs = {d[0]: str(d[1]) for d in result.description}
    assert sorted(theirs) == names
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == theirs
    order = [d[0] for d in result.description]
    rows = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in result.fetchall())
    assert found == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
