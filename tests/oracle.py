"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        v = float(f"{v:.9g}") if math.isfinite(v) else str(v)
        return int(v) if isinstance(v, float) and v.is_integer() else v
    return v if isinstance(v, (int, str, bool)) else str(v)


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_plain(getattr(v, "item", lambda v=v: v)()) for v in row) for row in frame[columns].itertuples(index=False)), key=str)


def assert_same(df, text, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    assert _rows(df.toPandas()) == _rows(con.execute(text).df())
