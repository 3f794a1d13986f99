"""Compare a query's rows with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def bag(columns: list[str], rows) -> Counter:
    """Rows as a bag, with columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(r[i]).__name__, _plain(r[i])) for i in order) for r in rows)


def differences(df, con, sql: str, show: int = 2) -> list[str]:
    """What differs between the query and its SQL; nothing when they agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    got, want = bag(df.columns, df.collect()), bag(names, cursor.fetchall())
    out = []
    if got.total() != want.total():
        out.append(f"{got.total()} rows against {want.total()}")
    for label, extra in (("only Spark", got - want), ("only SQL", want - got)):
        out += [f"{label}: {str(row)[:600]}" for row in list(extra)[:show]]
    return out
