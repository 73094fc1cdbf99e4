"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from depthcal.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.QUERIES[name](spark, SF).toPandas(), con.sql(q.SQL[name]).df()
    rows = lambda df: sorted(tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))
