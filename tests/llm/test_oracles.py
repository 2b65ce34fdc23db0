import os

import duckdb
import pytest

from campaignlab.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, sf001, name):
    con = duckdb.connect()
    for f in os.listdir(sf001):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf001}/{f}'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, sf001)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda rows: sorted(map(repr, rows))
    assert order(map(tuple, got.select(cols).collect())) == order(want.select(*cols).fetchall())
