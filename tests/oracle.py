"""Comparing a Spark result with DuckDB on the same tables."""

import os
from collections import Counter

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        p = f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(list(v.asDict().values()))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def bag(rows):
    return Counter(repr(r) for r in rows)


def compare(df, con, sql):
    cols = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = [tuple(plain(x[i]) for i in at) for x in r.fetchall()]
    a, b = bag(ours), bag(theirs)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
