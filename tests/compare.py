"""Runs a query and its SQL side by side, as a multiset of rows by column name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(value(r[i])).__name__, value(r[i])) for i in order) for r in rows)


def differences(spark, query, sql: str, folder: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        if (Path(folder) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    names = [x[0] for x in answer.description]
    want = rows_of(names, answer.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only in Spark {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"
    return ""
