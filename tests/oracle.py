"""Comparison of a query with its DuckDB SQL over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
    assert not bad, bad
