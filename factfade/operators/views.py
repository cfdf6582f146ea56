"""Entity and event views, counts, and reads by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.functions.scoring import decayed_confidence
from factfade.functions.text import ascii_lower
from factfade.model import Memory
from factfade.operators.visibility import (
    active_events,
    active_observations,
    entity_type_filter,
    event_filters,
    live_entities,
    with_live_event,
)

DEFAULT_ENTITIES = 50
DEFAULT_EVENTS = 20


def observation_counts(mem: Memory, as_of) -> DataFrame:
    """Active observations per entity."""
    return (
        active_observations(mem.observations, mem.events, as_of)
        .groupBy("entity_id").agg(F.count(F.lit(1)).alias("observation_count"))
    )


def _live_relations(mem: Memory) -> DataFrame:
    """Edges whose two ends are not deleted."""
    ends = live_entities(mem.entities).select("id")
    return (
        mem.relations
        .join(ends.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_semi")
        .join(ends.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_semi")
    )


def relation_counts(mem: Memory) -> DataFrame:
    """Live edges touching each entity, outgoing and incoming added."""
    return (
        _live_relations(mem)
        .select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("entity_id"))
        .groupBy("entity_id").agg(F.count(F.lit(1)).alias("relation_count"))
    )


def list_entities(
    mem: Memory, as_of, entity_type: str | None = None, limit: int = DEFAULT_ENTITIES
) -> DataFrame:
    """Entities with an observation or an edge, last changed first.

    ``limit`` 0 means the default, a negative one means all.
    """
    named = entity_type_filter(live_entities(mem.entities), entity_type)
    listed = named.join(
        observation_counts(mem, as_of).withColumnRenamed("entity_id", "id"), "id", "left"
    )
    edges = F.lit(0)
    if mem.relations is not None:
        listed = listed.join(
            relation_counts(mem).withColumnRenamed("entity_id", "id"), "id", "left"
        )
        edges = F.coalesce("relation_count", F.lit(0))
    listed = (
        listed.withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
        .filter((F.col("observation_count") > 0) | (edges > 0))
        .select("id", "name", "entity_type", "created_at", "updated_at", "observation_count")
        .orderBy(F.desc_nulls_last("updated_at"), "id")
    )
    limit = DEFAULT_ENTITIES if limit == 0 else limit
    return listed if limit < 0 else listed.limit(limit)


def event_counts(
    mem: Memory,
    as_of,
    query: str | None = None,
    event_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    limit: int = DEFAULT_EVENTS,
) -> DataFrame:
    """Live events with the number of their visible observations, latest first."""
    wanted = event_filters(
        active_events(mem.events, as_of), query, event_type, date_from, date_to
    )
    alive = mem.observations.filter(
        F.col("deleted_at").isNull() & F.col("superseded_by").isNull()
        & F.col("event_id").isNotNull()
    ).select("entity_id", "event_id")
    # The outer join to live events below already checks the event of each row.
    counts = (
        alive.join(live_entities(mem.entities).select(F.col("id").alias("entity_id")), "entity_id")
        .groupBy(F.col("event_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("observation_count"))
    )
    return (
        wanted.join(counts, "id", "left")
        .select(
            "id", "label", "event_date", "event_type", "context", "expires_at", "created_at",
            F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        )
        .orderBy(F.desc_nulls_last("event_date"), F.desc_nulls_last("created_at"), "id")
        .limit(limit if limit > 0 else DEFAULT_EVENTS)
    )


def observation_totals(mem: Memory, as_of) -> DataFrame:
    """One row: all, deleted, superseded and active observations."""
    active = active_observations(mem.observations, mem.events, as_of).agg(
        F.count(F.lit(1)).alias("active")
    )
    return mem.observations.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("deleted_at").alias("deleted"),
        F.count("superseded_by").alias("superseded"),
    ).withColumn("active", active.scalar())


def _event_columns() -> list[Column]:
    return [F.col("label").alias("event_label"), F.col("event_date"), F.col("event_type")]


def relations_of(mem: Memory, direction: str) -> DataFrame:
    """Edges with the entity they belong to and the name and type of the other end."""
    near, far = {
        "outgoing": ("from_entity_id", "to_entity_id"),
        "incoming": ("to_entity_id", "from_entity_id"),
    }[direction]
    others = live_entities(mem.entities).select(
        F.col("id").alias(far), F.col("name").alias("other_name"),
        F.col("entity_type").alias("other_type"),
    )
    return mem.relations.join(others, far).select(
        F.col(near).alias("entity_id"), "id", "from_entity_id", "to_entity_id",
        "relation_type", "context", "created_at", "other_name", "other_type",
    )


def _fetched(rows: DataFrame, mem: Memory, as_of, half_life) -> DataFrame:
    """Live observation rows with event columns, stored and effective confidence."""
    owners = live_entities(mem.entities).select(
        F.col("id").alias("entity_id"), F.col("name").alias("entity_name")
    )
    alive = rows.filter(F.col("deleted_at").isNull() & F.col("superseded_by").isNull())
    return (
        with_live_event(alive, mem.events, as_of, *_event_columns())
        .join(owners, "entity_id")
        .withColumn("stored_confidence", F.col("confidence"))
        .withColumn(
            "confidence",
            decayed_confidence(
                F.col("created_at"), F.col("stored_confidence"), F.col("access_count"),
                half_life, as_of,
            ),
        )
    )


_FETCHED = (
    "id", "entity_id", "entity_name", "entity_type", "content", "source", "stored_confidence",
    "confidence", "access_count", "last_accessed", "created_at", "event_id", "event_label",
    "event_date", "event_type",
)


def unique_positive_ids(requests: DataFrame) -> DataFrame:
    """Requests (req_id, pos, id) without ids <= 0 and without repeats, first position kept."""
    return (
        requests.filter(F.col("id") > 0)
        .groupBy("req_id", "id").agg(F.min("pos").alias("pos"))
    )


def observations_by_id(requests: DataFrame, mem: Memory, as_of, half_life) -> DataFrame:
    """Visible rows of each request in request order; the type is the copy on the row."""
    wanted = unique_positive_ids(requests)
    rows = mem.observations.join(wanted.select("id").distinct(), "id", "left_semi")
    return (
        wanted.join(_fetched(rows, mem, as_of, half_life), "id")
        .select("req_id", "pos", *_FETCHED)
        .orderBy("req_id", "pos")
    )


def request_totals(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requested and found counts per request."""
    requested = unique_positive_ids(requests).groupBy("req_id").agg(
        F.count(F.lit(1)).alias("requested")
    )
    returned = found.groupBy("req_id").agg(F.count(F.lit(1)).alias("total"))
    return (
        requests.select("req_id").distinct()
        .join(requested, "req_id", "left").join(returned, "req_id", "left")
        .select(
            "req_id",
            F.coalesce("requested", F.lit(0)).alias("requested"),
            F.coalesce("total", F.lit(0)).alias("total"),
        )
    )


def event_observations(event_ids: DataFrame, mem: Memory, as_of, half_life) -> DataFrame:
    """Visible rows of live events, oldest first.  ``event_ids`` has a column event_id."""
    rows = mem.observations.join(event_ids.select("event_id").distinct(), "event_id", "left_semi")
    return (
        _fetched(rows, mem, as_of, half_life)
        .select(*_FETCHED)
        .orderBy("event_id", "created_at", "id")
    )


def full_event(event_ids: DataFrame, mem: Memory, as_of, half_life) -> DataFrame:
    """Live events with their visible rows grouped by entity, flat.

    One row per observation (none: one row with NULLs), ordered by event, then by
    entity in the order of its first row, then by time.  ``total_observations``
    and ``entity_first_at`` come from pre-aggregated counts, not from a window
    over the whole event.
    """
    wanted = active_events(mem.events, as_of).join(
        event_ids.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi"
    )
    head = wanted.select(
        F.col("id").alias("event_id"), F.col("label").alias("event_label"), "event_date",
        "event_type", "context", "expires_at",
    )
    rows = mem.observations.join(
        wanted.select(F.col("id").alias("event_id")), "event_id", "left_semi"
    )
    owners = live_entities(mem.entities).select(
        F.col("id").alias("entity_id"), F.col("name").alias("entity_name"),
        F.col("entity_type").alias("owner_type"),
    )
    seen = (
        rows.filter(F.col("deleted_at").isNull() & F.col("superseded_by").isNull())
        .join(owners, "entity_id")
        .select(
            "event_id", "entity_name", F.col("owner_type").alias("entity_type"),
            "id", "content", "source", "access_count", "created_at",
            decayed_confidence(
                F.col("created_at"), F.col("confidence"), F.col("access_count"), half_life, as_of
            ).alias("confidence"),
        )
    )
    groups = seen.groupBy("event_id", "entity_name").agg(
        F.min(F.struct("created_at", "id")).alias("group_first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    totals = groups.groupBy("event_id").agg(F.sum("group_size").alias("total_observations"))
    return (
        head.join(totals, "event_id", "left")
        .join(seen.join(groups, ["event_id", "entity_name"]), "event_id", "left")
        .withColumn("total_observations", F.coalesce("total_observations", F.lit(0)))
        .orderBy("event_id", "group_first", "created_at", "id")
        .withColumn("group_first_at", F.col("group_first.created_at"))
        .drop("group_first")
    )


def entity_graph(names: DataFrame, mem: Memory, as_of, half_life) -> DataFrame:
    """Entities by name (any ASCII case) with observations and edges, flat.

    ``names`` has a column ``name``.  Each row is an observation or an edge, told
    apart by ``section``; an entity with neither has no rows.  Observations come
    newest first.
    """
    found = (
        live_entities(mem.entities).withColumn("_key", ascii_lower(F.col("name")))
        .join(names.select(ascii_lower(F.col("name")).alias("_key")).distinct(), "_key", "left_semi")
        .select("id", "name", "entity_type")
    )
    entity = found.select(
        F.col("id").alias("entity_id"), F.col("name").alias("entity_name"),
        F.col("entity_type").alias("entity_kind"),
    )
    keys = entity.select("entity_id")
    rows = mem.observations.join(keys, "entity_id", "left_semi")
    observations = _fetched(rows, mem, as_of, half_life).select(
        "entity_id", F.lit("observation").alias("section"), "id", "content",
        F.col("stored_confidence"), F.col("confidence"), "created_at",
        F.col("event_label"), F.col("entity_type").alias("row_type"),
        F.lit(None).cast("string").alias("relation_type"),
        F.lit(None).cast("string").alias("other_name"),
        F.lit(None).cast("string").alias("other_type"),
    )

    def edges(direction: str) -> DataFrame:
        return relations_of(mem, direction).join(keys, "entity_id", "left_semi").select(
            "entity_id", F.lit(direction).alias("section"), "id",
            F.col("context").alias("content"),
            F.lit(None).cast("double").alias("stored_confidence"),
            F.lit(None).cast("double").alias("confidence"), "created_at",
            F.lit(None).cast("string").alias("event_label"),
            F.lit(None).cast("string").alias("row_type"),
            "relation_type", "other_name", "other_type",
        )

    parts = observations
    if mem.relations is not None:
        parts = parts.unionByName(edges("outgoing")).unionByName(edges("incoming"))
    return entity.join(parts, "entity_id").orderBy(
        "entity_id",
        F.when(F.col("section") == "observation", 0)
        .when(F.col("section") == "outgoing", 1).otherwise(2),
        F.when(F.col("section") == "observation", F.col("created_at")).desc_nulls_last(),
        "id",
    )
