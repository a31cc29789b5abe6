"""Compares a query with its SQL, run by DuckDB over the same files."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if isinstance(value, Decimal) else value


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(_plain(dict(zip(names, row))[c]) for c in columns) for row in result.fetchall())
    assert ours == theirs, f"only here {list((ours - theirs))[:3]}, only there {list((theirs - ours))[:3]}"
