"""Constraint check over all tables of a scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.functions.text import ascii_lower, trim_white
from factfade.model import Memory

# Rule, table, column, table it must point into.
REFERENCES = (
    ("orphan_entity", "observations", "entity_id", "entities"),
    ("orphan_event", "observations", "event_id", "events"),
    ("orphan_target", "observations", "superseded_by", "observations"),
    ("orphan_run", "observations", "superseded_by_run", "runs"),
    ("orphan_from", "relations", "from_entity_id", "entities"),
    ("orphan_to", "relations", "to_entity_id", "entities"),
    ("orphan_decision_run", "decisions", "run_id", "runs"),
    ("orphan_decision_entity", "decisions", "entity_id", "entities"),
    ("orphan_decision_target", "decisions", "target_obs_id", "observations"),
)


def integrity_violations(mem: Memory) -> DataFrame:
    """(rule, table, id) of every row that breaks a rule."""
    found: list[DataFrame] = []

    def report(rule: str, table: str, rows: DataFrame, key: str = "id") -> None:
        found.append(
            rows.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.col(key).alias("id"))
        )

    for rule, table, column, target in REFERENCES:
        rows, known = getattr(mem, table), getattr(mem, target)
        if rows is None or known is None:
            continue
        report(
            rule, table,
            rows.filter(F.col(column).isNotNull()).select("id", column)
            .join(known.select(F.col("id").alias(column)), column, "left_anti"),
        )
    names = mem.entities.select("id", ascii_lower(F.col("name")).alias("key"))
    report("duplicate_name", "entities", _repeated(names, ["key"]))
    if mem.relations is not None:
        edge = ["from_entity_id", "to_entity_id", "relation_type"]
        report("duplicate_edge", "relations", _repeated(mem.relations.select("id", *edge), edge))
    if mem.embeddings is not None:
        cache = mem.embeddings
        blank = F.lit(False)
        for part in ("provider", "endpoint_key", "model_id"):
            blank = blank | F.coalesce(trim_white(F.col(part)) == "", F.lit(True))
        report("blank_cache_key", "embeddings", cache.filter(blank), "observation_id")
        report("bad_dimension", "embeddings", cache.filter(F.col("dimensions") <= 0), "observation_id")
        report(
            "empty_vector", "embeddings",
            cache.filter(F.col("embedding").isNull() | (F.size("embedding") == 0)), "observation_id",
        )
        report(
            "orphan_observation", "embeddings",
            cache.join(
                mem.observations.select(F.col("id").alias("observation_id")), "observation_id",
                "left_anti",
            ),
            "observation_id",
        )
    return reduce(DataFrame.unionByName, found)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All but the lowest id of each key.  Counts meet before rows do."""
    several = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest")
    ).filter(F.col("n") > 1)
    return rows.join(several, keys).filter(F.col("id") > F.col("lowest"))
