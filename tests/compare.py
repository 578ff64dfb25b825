"""Compares a query with its SQL in DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(plain(row[k])) for k in order) for row in data)


def difference(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    db = database(sf_dir)
    found = db.sql(sql)
    theirs = rows(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(found.columns)}"
    if mine == theirs:
        return ""
    a, b = set(mine), set(theirs)
    return f"{name}: {len(mine)} and {len(theirs)} rows; only in Spark {sorted(a - b)[:3]}, only in SQL {sorted(b - a)[:3]} ({len(a - b)}, {len(b - a)})"
