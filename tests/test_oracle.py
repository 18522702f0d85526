"""Every SQL-checked query equals its DuckDB twin at sf0.001 (the driver runs sf0.01)."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "∅"
    if isinstance(v, (float, np.floating)):
        return "∅" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, np.integer):
        return str(int(v))
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _canon(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    assert _canon(got) == _canon(exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "l_returnflag" in df.columns
