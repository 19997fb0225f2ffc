"""Runs queries against their SQL in DuckDB and compares row by row."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    rows = con.execute(sql)
    return [c[0] for c in rows.description], rows.fetchall()


def _plain(x):
    if isinstance(x, float) and (math.isnan(x)):
        return None
    if hasattr(x, "as_tuple") or isinstance(x, float):
        return float(x)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs first."""
    columns, want = expected(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for a, b in zip(_rows(df.columns, got), _rows(columns, want), strict=True):
        if a != b:
            return f"{a} instead of {b}"
    return None
