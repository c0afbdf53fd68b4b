"""Spark results against DuckDB results, row by row, whatever the order."""

from __future__ import annotations

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x))
    if isinstance(x, (int, float)) or hasattr(x, "item"):
        return None if x != x else round(float(x), 9) + 0.0
    return str(x)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def oracle(sql: str, folder: str = SMALL) -> pd.DataFrame:
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con.execute(sql).df()
