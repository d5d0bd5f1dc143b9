"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from '{path}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)) else round(float(x), 9) if isinstance(x, float) else str(x)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (len(a), len(b), list(set(a) - set(b))[:3], list(set(b) - set(a))[:3])
