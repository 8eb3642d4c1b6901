"""Compare a query's rows with its SQL's in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) and hasattr(v, "__float__") else str(v) for v in row))
    return sorted(rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = plain(got), plain(want)
    if a == b:
        return ""
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} and {len(b)} rows; first difference {first}"
