"""Compares a query with its SQL in DuckDB on the same tables."""

import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.01"


def duck(dir_=SMALL):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(dir_):
        con.execute(f"create view {name.split('.')[0]} as select * from '{dir_}/{name}'")
    return con


def same(spark, name, queries, oracles, dir_=SMALL, digits=9):
    got = queries[name](spark, dir_).toPandas()
    want = duck(dir_).sql(oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(df):
        clean = lambda x: round(x, digits) + 0.0 if isinstance(x, float) else x
        return sorted([tuple(None if v is None or v is pd.NA or v != v else clean(v) for v in r) for r in df[columns].itertuples(index=False)], key=repr)

    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
    return len(a)
