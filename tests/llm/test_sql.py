"""Queries of the operators with SQL give the SQL's rows."""

import duckdb
import pytest

from entwine.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = catalog.queries()[name](spark, DATA)
    expected = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in places) for r in expected.fetchall())
