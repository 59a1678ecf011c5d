"""Runs a query and its SQL and compares them as bags of rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return round(v, 6) if isinstance(v, float) else v


def bag(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(_plain(x) for x in row) for row in pdf[columns].astype(object).itertuples(index=False)), key=repr)


def same(spark_df, con, sql):
    got, want = bag(spark_df.toPandas()), bag(con.execute(sql).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]
