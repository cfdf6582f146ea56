"""Small memory stores written as literals."""

from __future__ import annotations

from datetime import datetime, timedelta

from factfade.model import Memory
from factfade.schemas import MEMORY_TABLES, table_schema

NOW = datetime(2026, 5, 1, 12, 0, 0)
OLD = datetime(2020, 1, 1)


def ago(**kwargs) -> datetime:
    return NOW - timedelta(**kwargs)


DEFAULTS = {
    "entities": {"created_at": OLD, "updated_at": OLD},
    "observations": {"source": "user", "confidence": 1.0, "access_count": 0, "created_at": NOW},
    "events": {"created_at": OLD},
    "relations": {"created_at": OLD},
}


def table(spark, name, rows):
    schema = table_schema(name)
    filled = [{**DEFAULTS.get(name, {}), **row} for row in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in filled], schema)


def memory(spark, **tables) -> Memory:
    return Memory(**{name: table(spark, name, tables.get(name, [])) for name in MEMORY_TABLES})


def obs(id, entity_id, content, **more):
    return {"id": id, "entity_id": entity_id, "content": content, **more}


def ent(id, name, **more):
    return {"id": id, "name": name, **more}


def facts(spark, *rows):
    """(entity, observation) or dicts, numbered in order, all in one batch."""
    out = []
    for i, row in enumerate(rows):
        row = row if isinstance(row, dict) else {"entity": row[0], "observation": row[1]}
        out.append((
            row.get("batch_id", 0), i, row["entity"], row.get("entity_type"), row["observation"],
            row.get("source"), row.get("confidence"), row.get("event_id"),
        ))
    return spark.createDataFrame(
        out,
        "batch_id long, seq long, entity string, entity_type string, observation string, "
        "source string, confidence double, event_id long",
    )


def queries(spark, *rows):
    return spark.createDataFrame(
        [(i + 1, text, limit) for i, (text, limit) in enumerate(rows)],
        "query_id long, text string, max_results int",
    )


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
