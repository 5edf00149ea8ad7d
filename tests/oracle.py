"""Holds a query's rows against its DuckDB SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty where both agree."""
    got_columns, got = rows_of(df.columns, df.collect())
    want = duck(sf_dir).execute(sql)
    want_columns, want = rows_of([d[0] for d in want.description], want.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns}, wanted {want_columns}"
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"{len(got)} rows, wanted {len(want)}; first difference {first}"
    return ""
