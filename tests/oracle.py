"""Runs a query and its SQL on the same tables and compares the rows."""

import decimal
import glob
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    got = con.sql(sql)
    names = list(got.columns)
    cols = sorted(names)
    return cols, sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall()), key=repr)
