"""Compares a query's rows with DuckDB's for the SQL that goes with it."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return v


def duck(folder=SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def assert_same(df, sql, folder=SMALL):
    cols = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    answer = duck(folder).execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = Counter(tuple(_plain(dict(zip(names, r))[c]) for c in cols) for r in answer.fetchall())
    assert got - want == Counter() and want - got == Counter()
