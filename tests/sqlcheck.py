"""Compares a query with its DuckDB statement on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, query, sql):
    df = query(spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cur = connect().execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
    assert ours == theirs
