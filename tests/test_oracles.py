"""Every registered query of the linkage operators against its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lattica.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, duck, name):
    a, b = plain(registry.queries()[name](spark, sf).toPandas()), plain(duck.execute(registry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-12, atol=1e-12, equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["marker", "contig", "n"] and df.count() > 0
