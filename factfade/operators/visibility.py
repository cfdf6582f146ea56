"""Which rows can be seen at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.functions.text import literal_contains
from factfade.model import Memory
from factfade.session import at

# Rows without a key are spread over this many join partitions instead of one.
_NULL_SPREAD = 4096


def active_events(events: DataFrame, as_of) -> DataFrame:
    """Events that never end or end strictly after ``as_of``."""
    return events.filter(F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of)))


def spread_nulls(key: Column, salt: Column) -> Column:
    """``key``, or a negative stand-in that matches nothing but spreads evenly."""
    return F.coalesce(key, -1 - F.pmod(F.xxhash64(salt), F.lit(_NULL_SPREAD)))


def with_live_event(rows: DataFrame, events: DataFrame, as_of, *columns: Column) -> DataFrame:
    """Rows whose event is absent or live; ``columns`` of the event are added.

    An event id without an event counts as not live.
    """
    live = active_events(events, as_of).select(F.col("id").alias("_event"), *columns)
    return (
        rows.join(live, spread_nulls(rows["event_id"], rows["id"]) == live["_event"], "left")
        .filter(F.col("event_id").isNull() | F.col("_event").isNotNull())
        .drop("_event")
    )


def active_observations(observations: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Not deleted, not superseded, and without an event or with a live one."""
    alive = observations.filter(F.col("deleted_at").isNull() & F.col("superseded_by").isNull())
    return with_live_event(alive, events, as_of)


def live_entities(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("deleted_at").isNull())


def live_observations(mem: Memory, as_of, *columns: Column) -> DataFrame:
    """Active observations of entities that are not deleted.

    ``columns`` of the entity may be added to the rows.
    """
    owners = live_entities(mem.entities).select(F.col("id").alias("entity_id"), *columns)
    return active_observations(mem.observations, mem.events, as_of).join(owners, "entity_id")


def event_filters(
    events: DataFrame,
    query: str | None = None,
    event_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Label, type and date conditions; dates compare as text."""
    if query:
        events = events.filter(literal_contains(F.col("label"), query))
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    if date_from:
        events = events.filter(F.col("event_date") >= date_from)
    if date_to:
        events = events.filter(F.col("event_date") <= date_to)
    return events


def entity_type_filter(entities: DataFrame, entity_type: str | None) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type) if entity_type else entities
