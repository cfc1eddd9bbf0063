"""Spark queries against their SQL in DuckDB on one scale."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def database(d: str = DATA):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return c


def compare(spark, query, sql: str, d: str = DATA) -> None:
    df = query(spark, d)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = database(d).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want
