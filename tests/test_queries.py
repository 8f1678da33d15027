"""Every registered query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from polyad.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def value(x):
    if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return "null"
    return f"{x:.5g}" if isinstance(x, (float, np.floating)) else str(x)


def lines(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sql, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        assert lines(got) == lines(sql.sql(registry.oracle_sql()[name]).df())
    else:
        assert len(got) and not got.isna().any().any()


def test_flagship(spark):
    assert registry.flagship(spark, SF).limit(3).count() == 3
