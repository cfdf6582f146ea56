"""The set of tables one scope consists of."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Memory:
    """DataFrames of one scope.  Nothing is read until a result is asked for."""

    entities: DataFrame
    observations: DataFrame
    events: DataFrame
    relations: DataFrame | None = None
    runs: DataFrame | None = None
    decisions: DataFrame | None = None
    decision_sources: DataFrame | None = None
    embeddings: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> "Memory":
        return replace(self, **tables)


@dataclass(frozen=True)
class Write:
    """Outcome of a write job.

    ``memory`` is the state after it.  ``appended`` holds only the new rows of
    tables that grew, ``rewritten`` the whole of tables whose rows changed, so a
    publisher writes no more than it must.
    """

    memory: Memory
    result: DataFrame
    appended: dict[str, DataFrame] = field(default_factory=dict)
    rewritten: dict[str, DataFrame] = field(default_factory=dict)
