"""Spark rows against DuckDB rows of the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def oracle(sql: str, sf_dir: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con.sql(sql).df()


def plain(x) -> str:
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
