"""Runs registered queries against DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple("null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(rows)


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    a, e = normal(actual), normal(expected)
    if len(a) != len(e):
        return f"rows {len(a)} != {len(e)}; spark {a[:3]} sql {e[:3]}"
    bad = [(x, y) for x, y in zip(a, e) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    types = {c: (actual[c].dtype.kind, expected[c].dtype.kind) for c in actual.columns}
    odd = {c: t for c, t in types.items() if t[0] != t[1]}
    return f"types {odd}" if odd and len(actual) else None
