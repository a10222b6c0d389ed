"""Every query with SQL against DuckDB over the same tables, and every other one for running at all."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallyspark.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    kind = type(v).__name__
    if kind in ("Decimal", "float", "float64", "float32"):
        return round(float(v), 5)
    if "int" in kind:
        return int(v)
    return str(v)[:10] if kind in ("Timestamp", "date", "datetime") else v


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name not in ORACLE_SQL:
        assert len(got) >= 0
        return
    want = db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
