"""Queries by name, each with the DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DECIMALS = 6


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same computation for DuckDB."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, sf_dir: plain(function(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns both engines print alike: times as text, doubles rounded, ids long."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "double":
            c = F.round(c, DECIMALS)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def ts(expression: str) -> str:
    """DuckDB text of a time, as ``plain`` writes it."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def num(expression: str) -> str:
    return f"round({expression}, {DECIMALS})"
