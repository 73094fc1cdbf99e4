"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from depthcal import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    clean = lambda v: None if v is None else round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_and_sweep(spark):
    assert entry.entry(spark).count() > 0
    rows = q.QUERIES["sweep_all"](spark, SF).collect()
    assert len(rows) == 20 and all(r["n_groups_scored"] <= r["n_groups_total"] for r in rows)
    native = q.QUERIES["loo_summary"](spark, SF).first()
    linear = next(r for r in rows if (r["anchor"], r["method"], r["robust"]) == ("mask_mean", "linear", False))
    assert linear["mean_loo_mae_cal"] == pytest.approx(native["mean_loo_mae_cal"], rel=1e-6)
    assert len(q.QUERIES["sweep_ranked"](spark, SF).collect()) == 15


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
