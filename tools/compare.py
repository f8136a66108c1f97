"""Comparing a Spark result with its SQL check."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows) -> list[tuple]:
    """Rows with columns in name order, sorted, in plain types."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows], key=repr)


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def difference(df, con, sql: str) -> tuple[str | None, int]:
    """What differs, or None, and the number of Spark rows."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(got)
    want = rows_of(columns, cur.fetchall())
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(got)} vs {len(want)} rows, {len(diff)} differ; first {diff[:2]}", len(got)
    return None, len(got)
