"""Compares a query with its SQL on DuckDB: rows, columns and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def connect(sf: str):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(sf).iterdir():
        c.execute(f"create view {p.name.split('.')[0]} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    c = connect(sf)
    cur = c.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols), (df.columns, cols)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2])
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]
    return len(got)
