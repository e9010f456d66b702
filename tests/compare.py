"""Runs registered queries beside their SQL in DuckDB and compares rows, columns and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(con: duckdb.DuckDBPyConnection, sf_dir: str) -> None:
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE OR REPLACE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return str(v)


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if both have the same columns and the same rows in any order."""
    theirs = con.sql(sql)
    names, others = sorted(df.columns), sorted(theirs.columns)
    if names != others:
        return f"columns {names} and {others}"
    mine = sorted(str([_plain(r[n]) for n in names]) for r in df.collect())
    rows = theirs.fetchall()
    place = [theirs.columns.index(n) for n in names]
    sqls = sorted(str([_plain(r[i]) for i in place]) for r in rows)
    if len(mine) != len(sqls):
        return f"{len(mine)} rows and {len(sqls)}"
    for a, b in zip(mine, sqls, strict=True):
        if a != b:
            return f"{a[:300]} and {b[:300]}"
    return ""
