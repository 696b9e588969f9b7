"""Holds a query's rows against its SQL on DuckDB, whatever their order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql) -> str | None:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows and {len(expected)}; e.g. {sorted(set(got) ^ set(expected), key=repr)[:4]}"
    bad = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else None
