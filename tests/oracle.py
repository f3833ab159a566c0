"""Spark rows against DuckDB rows, value by value."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("LISTLOOM_TESTDATA", "/root/testdata/sf0.001")


def connection(sf_dir=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
