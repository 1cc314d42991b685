"""Spark rows against DuckDB rows, in any order."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def database(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else p
        c.execute(f"create view {p.stem} as select * from '{at}'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def same(df, sql, sf):
    cols, ours = rows_of(df)
    got = database(sf).sql(sql)
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in got.fetchall()), key=repr)
    assert ours == theirs
