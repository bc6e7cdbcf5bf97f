"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v).__name__) if v is None else "", v if not isinstance(v, float) else round(v, 3)) if v is not None else (False, "", 0) for v in row)


def assert_same(df, sql: str, sf_dir: str) -> None:
    got = df.collect()
    names = sorted(df.columns)
    want = connection(sf_dir).sql(sql)
    assert sorted(want.columns) == names
    rows = [tuple(r[n] for n in names) for r in got]
    at = [want.columns.index(n) for n in names]
    other = [tuple(r[i] for i in at) for r in want.fetchall()]
    assert len(rows) == len(other)
    for x, y in zip(sorted(rows, key=_key), sorted(other, key=_key), strict=True):
        for a, b in zip(x, y, strict=True):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (x, y)
