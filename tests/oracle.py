"""Run a named query and its SQL side by side on the same tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(directory: str):
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)
    return [columns[i] for i in order], body


def compare(spark, con, directory, query, sql):
    """None when equal, else a short text on the first difference."""
    df = query(spark, directory)
    left = table_of(df.columns, df.collect())
    cursor = con.execute(sql)
    right = table_of([c[0] for c in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        a, b = set(map(repr, left[1])), set(map(repr, right[1]))
        return f"rows {len(left[1])} vs {len(right[1])}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return None if left[1] else "empty result"
