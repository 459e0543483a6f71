"""Compare a query with its SQL over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = Counter(tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall())
    assert not got - want and not want - got, (list((got - want).items())[:3], list((want - got).items())[:3])
