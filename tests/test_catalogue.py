import duckdb
import pandas as pd
import os

import pytest

from crateflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DIR):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DIR}/{name}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) < 5e-7) for p, q in zip(x, y, strict=True)), (x, y)
