"""The queries that SQL can tell, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tesselake.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = QUERIES[name](spark, DATA)
    theirs = con.sql(ORACLE_SQL[name])
    assert sorted(theirs.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*theirs.columns).collect())) == sorted(theirs.fetchall())
