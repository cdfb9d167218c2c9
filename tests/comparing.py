"""Rows of a Spark result against those of DuckDB, order aside."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if np.isscalar(pd.isna(value)) and pd.isna(value):
        return "NULL"
    if isinstance(value, (float, np.floating)):
        return f"{value:.9g}"
    return str(value)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(plain(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))
