"""Runs oracle SQL in DuckDB and compares its rows with a query's, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return c


def _cell(x: object) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(_cell, x)) + "]"
    if str(x) in ("NaT", "<NA>"):
        return "∅"
    try:
        f = float(x)
        return "0" if f == 0 else f"{f:.9g}"
    except (TypeError, ValueError):
        return str(x)


def compare(pdf, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """OK, or what differs."""
    odf = c.sql(sql).df()
    if sorted(pdf.columns) != sorted(odf.columns):
        return f"columns {sorted(pdf.columns)} against {sorted(odf.columns)}"
    cols = sorted(pdf.columns)
    a, b = (sorted(tuple(map(_cell, r)) for r in x[cols].itertuples(index=False)) for x in (pdf, odf))
    if a == b:
        return "OK"
    sa, sb = set(a), set(b)
    return f"{len(a)} rows against {len(b)}; only ours {sorted(sa - sb)[:3]}; only the oracle's {sorted(sb - sa)[:3]}"
