"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    out = con.sql(sql)
    return out.columns, out.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return bytes(value) if isinstance(value, bytearray) else value


def counted(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, rows = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = counted(df.columns, df.collect()), counted(columns, rows)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
