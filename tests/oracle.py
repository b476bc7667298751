"""Holds a query's rows against DuckDB's for its SQL."""

import datetime
import os
from pathlib import Path

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted([shown(r[i]) for i in at] for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    rel = connect(sf_dir).sql(sql)
    want = table(rel.columns, rel.fetchall())
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
