"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def rows_of(columns, rows):
    return sorted(([plain(r[c]) for c in columns] for r in rows), key=repr)


def same_rows(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert rows_of(columns, df.collect()) == rows_of(columns, want)
