"""The SQL of this folder gives the queries' rows."""

import duckdb
import pytest

from memloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = c.sql(queries.ORACLE_SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert sorted(tuple(x) for x in df.collect()) == sorted(tuple(x[r.columns.index(k)] for k in df.columns) for x in r.fetchall())
