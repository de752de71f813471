"""Compares a Spark query with its SQL on DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

SF_DIR = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


def in_order(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(spark, query, sql: str, sf_dir: Path = SF_DIR) -> None:
    df = query(spark, str(sf_dir))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for p in sf_dir.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(sql)
    names = list(want.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = in_order(tuple(r[c] for c in columns) for r in df.collect())
    assert got == in_order(tuple(r[i] for i in at) for r in want.fetchall())
