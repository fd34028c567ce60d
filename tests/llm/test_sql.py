"""Queries of this folder that SQL can tell, against DuckDB."""

import duckdb
import pytest

from ravelin.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    result = c.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = queries()[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(result.fetchall())
