"""Every query against its SQL on the smallest tables."""

import subprocess
import sys

import duckdb
import pytest

from tesselake.oracles import ORACLE_SQL
from tesselake.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("supplier", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(ORACLE_SQL[name]).columns)
    mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    theirs = sorted(duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=key)
    assert mine == theirs


def test_restore_order_first_in_a_session(duck, tmp_path):
    """The optimizer's choices depend on the ids of columns, and those on what a JVM has planned before: a new one each time."""
    run = f"""
from pyspark.sql import SparkSession
from tesselake.queries import QUERIES
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("OFF")
QUERIES["restore_order"](s, "{DATA}").write.parquet("{tmp_path}/out")
"""
    subprocess.run([sys.executable, "-c", run], check=True, timeout=300, capture_output=True)
    mine = duck.sql(f"select path, is_dir, place from '{tmp_path}/out/*.parquet' order by place").fetchall()
    assert mine == duck.sql(f"select path, is_dir, place from ({ORACLE_SQL['restore_order']}) order by place").fetchall()
