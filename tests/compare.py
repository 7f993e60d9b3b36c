"""Rows of a Spark query and of its SQL, in one comparable form."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (float, np.floating)):
        return repr(float(v) + 0.0).removesuffix(".0")
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return str(v).removesuffix(".0")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None))
