"""Spark results against DuckDB's on the same files."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def duck(data):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("" if x is None or x is pd.NA or isinstance(x, float) and x != x else f"{float(x):.5f}" if isinstance(x, int | float) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x) for x in row))
    return sorted(rows)


def same(spark, data, query, sql):
    got, want = query(spark, data).toPandas(), duck(data).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)
