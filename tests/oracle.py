"""Compare a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return int(x) if isinstance(x, bool) is False and isinstance(x, int) else x


def rows(names: list[str], data) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in data)


def differ(df, sql: str, con) -> str:
    """Empty if both give the same rows."""
    a_names, a = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    b_names, b = rows([d[0] for d in con.description], con.fetchall())
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
