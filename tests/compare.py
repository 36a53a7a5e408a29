"""Order-insensitive comparison of a query with its oracle."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "as_tuple"):
        return float(x)
    return float(f"{x:.12g}") if isinstance(x, float) else x


def rows(names, found) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(value(r[k]) for k in order) for r in found)


def differ(df, con, sql) -> str:
    """Empty if rows, column names and values agree."""
    made = con.sql(sql)
    if sorted(df.columns) != sorted(made.columns):
        return f"columns {sorted(set(df.columns) ^ set(made.columns))}"
    a, b = rows(df.columns, df.collect()), rows(made.columns, made.fetchall())
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).elements())[:2]}, only there {list((b - a).elements())[:2]}"
