"""Runs a registered query in Spark and its text in DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "as_tuple"):  # Decimal
        return f"{float(value):.6f}"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return normal([d[0] for d in result.description], result.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(left[1]), set(right[1])
    return (
        f"{len(left[1])} rows != {len(right[1])} rows; columns {left[0]}; "
        f"only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    )
