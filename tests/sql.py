"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    result = con.sql(sql)
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
