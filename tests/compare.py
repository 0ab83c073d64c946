"""Runs a registered query and its oracle on the same tables and compares rows, order aside."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def oracle(sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def same(df, sql, sf=SF):
    names, want = oracle(sql, sf)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in want]
    assert len(got) == len(want), (len(got), len(want))
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]
    return len(got)
