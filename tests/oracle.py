"""The driver's comparison in small: a query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def connect(sf):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = f"{sf}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.astype(object).itertuples(index=False))


def empty_copies(spark, sf, target):
    """The tables of sf without their rows."""
    for f in os.listdir(sf):
        spark.read.parquet(f"{sf}/{f}").limit(0).coalesce(1).write.parquet(f"{target}/{f}")
    return str(target)
