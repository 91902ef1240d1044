"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def database(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def _plain(v: object) -> object:
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
        return ""
    return v


def rows(df, columns: list[str]) -> list[str]:
    return sorted(str([_plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


def same(spark_df, sql: str, db: duckdb.DuckDBPyConnection) -> None:
    a, b = spark_df.toPandas(), db.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows(a, columns) == rows(b, columns)
