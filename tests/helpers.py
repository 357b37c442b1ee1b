"""Comparing a Spark result with DuckDB SQL over the same Parquet files."""

import datetime
import os

import duckdb


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, datetime.datetime):
        return x.date().isoformat() if x.time() == datetime.time() else x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = os.path.join(folder, f, "*.parquet") if os.path.isdir(os.path.join(folder, f)) else os.path.join(folder, f)
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall()), sorted(found.columns)
