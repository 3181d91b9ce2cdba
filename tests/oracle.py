"""Run a query on Spark and its oracle on DuckDB and compare them as unordered rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from assayer.session import TABLES


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.10g}"))
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    return ordered([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return ordered(df.columns, df.collect())


def difference(spark, folder, query, sql) -> str:
    """Empty text when both sides agree, else a short description."""
    cols, rows = spark_rows(query(spark, folder))
    if sql is None:
        return "" if rows else "no rows"
    want_cols, want = oracle_rows(folder, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}; spark {rows[:2]} oracle {want[:2]}"
    for a, b in zip(rows, want):
        if a != b:
            return f"spark {a} oracle {b}"
    return ""
