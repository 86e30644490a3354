"""A query's rows against its SQL in DuckDB, on the same Parquet tables."""

import glob
import os

import duckdb
import pandas as pd


def plain(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    return v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else list(v) if hasattr(v, "tolist") else v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(float(x) if isinstance(x := plain(v), int) and not isinstance(x, bool) else x for v in r)) for r in frame.itertuples(index=False))


def duck(sql, d):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.execute(sql).fetchdf()


def agrees(spark, f, sql, d):
    a, b = f(spark, d).toPandas(), duck(sql, d)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
