"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from helixflow.jobs import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def shaped(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu":
            df[c] = df[c].astype("int64")
        elif df[c].dtype == object:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_query_equals_sql(spark, sf_dir, db, name):
    pd.testing.assert_frame_equal(shaped(catalog.QUERIES[name](spark, sf_dir).toPandas()), shaped(db.sql(catalog.ORACLE_SQL[name]).df()), check_exact=False, rtol=1e-9)


def test_entry_point():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
