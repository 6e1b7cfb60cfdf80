"""Comparing a query's rows with its oracle's, as multisets with columns by name."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def _plain(v):
    if isinstance(v, float):
        return f"{v:.10g}"
    if isinstance(v, Decimal):
        return f"{float(v):.10g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def differences(spark, name: str, query, sql: str, folder: str) -> str:
    """Empty where both agree, else what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    made = query(spark, folder)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(made.columns):
        return f"{name}: columns {sorted(made.columns)} and {sorted(names)}"
    have = Counter(tuple(_plain(r[c]) for c in names) for r in made.collect())
    want = Counter(tuple(map(_plain, r)) for r in cur.fetchall())
    if have == want:
        return ""
    return f"{name}: {have.total()} and {want.total()} rows; only ours {list((have - want).items())[:2]}; only the oracle's {list((want - have).items())[:2]}"
