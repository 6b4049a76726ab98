"""Run a query and its SQL twin and compare sorted rows."""

from __future__ import annotations

import math
import os
import time
from datetime import date, datetime

import duckdb

SPENT: dict[str, float] = {}
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "null"
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return _cell(float(value))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else a short account of the difference."""
    began = time.time()
    df = fn(spark, sf_dir)
    collected = df.collect()
    SPENT[name] = time.time() - began
    got_cols, got = rows(df.columns, collected)
    rel = con.execute(sql)
    want_cols, want = rows([c[0] for c in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} against {want_cols}"
    if got != want:
        left, right = set(got), set(want)
        return (f"{name}: {len(got)} rows against {len(want)}; only here {list(left - right)[:3]};"
                f" only there {list(right - left)[:3]}")
    return None
