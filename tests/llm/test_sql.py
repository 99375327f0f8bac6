"""The operators' queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracewright.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op3_warc", "op4_repeated_passages", "op6_embedding_near_dedup"])
def test_query_equals_sql(spark, data, duck, name):
    want = duck.sql(SQL[name])
    df = QUERIES[name](spark, data).select(want.columns)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got and got == sorted(want.fetchall(), key=str)
