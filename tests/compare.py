"""Rows of a query and of its SQL, in comparable form."""

import os

import duckdb
import pandas as pd


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    tell = lambda v: "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(tell, r)) for r in frame[columns].itertuples(index=False))


def duck(folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{folder}/{f}'")
    return con


def assert_same(spark, folder: str, query, sql: str) -> None:
    got, want = query(spark, folder).toPandas(), duck(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
