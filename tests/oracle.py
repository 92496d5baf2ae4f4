"""Compares a query's rows with those of its SQL run by DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    con.execute(sql)
    return [d[0] for d in con.description], con.fetchall()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    at = [df.columns.index(n) for n in sorted(names)]
    to = [names.index(n) for n in sorted(names)]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    a = sorted((tuple(_value(r[i]) for i in at) for r in got), key=key)
    b = sorted((tuple(_value(r[i]) for i in to) for r in want), key=key)
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    for x, y in zip(a, b, strict=True):
        assert x == y, (sorted(names), x, y)
