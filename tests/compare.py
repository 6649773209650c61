"""Runs a query and its SQL over the same tables and compares names and rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(value):  # noqa: ANN001, ANN201
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return plain(float(value)) if value != value.to_integral_value() else int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:  # noqa: ANN001
    """Empty if both have the same columns and rows, in any order."""
    cursor = con.execute(sql)
    theirs_cols = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(theirs_cols):
        return f"columns {cols} and {sorted(theirs_cols)}"
    order = [theirs_cols.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in order) for r in theirs), key=repr)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}; only here {[x for x in a if x not in b][:3] if len(a) < 20000 else ''}; only SQL {[x for x in b if x not in a][:3] if len(a) < 20000 else ''}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return ""
