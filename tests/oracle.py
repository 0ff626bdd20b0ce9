"""A query beside its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def same(spark_df, con, sql: str) -> None:
    names = sorted(spark_df.columns)
    got = sorted([tuple(plain(r[c]) for c in names) for r in spark_df.collect()], key=str)
    rel = con.execute(sql)
    have = [d[0] for d in rel.description]
    assert sorted(have) == names
    want = sorted([tuple(plain(r[have.index(c)]) for c in names) for r in rel.fetchall()], key=str)
    assert got == want
