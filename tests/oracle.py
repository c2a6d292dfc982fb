"""Compares a query's rows with its DuckDB SQL's."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    cols = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 6) if not isinstance(v, (str, bytes)) else v

    return cols, sorted(([plain(v) for v in row] for row in frame[cols].astype(object).itertuples(index=False)), key=repr)


def sql_rows(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return rows_of(c.sql(sql).df())
