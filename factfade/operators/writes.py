"""Writes as jobs from tables to tables.

A batch of facts is taken as a whole or not at all.  New ids follow the order of
the batch.  Every group that could be hot (one entity, one content) is reduced by
an aggregation before rows meet it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.functions.text import ascii_lower, is_blank, none_if_empty, trim_white
from factfade.functions.times import parse_expiry
from factfade.model import Memory, Write
from factfade.operators.cleanup import digest
from factfade.operators.hints import conflict_hints
from factfade.operators.ordering import number_rows, with_previous
from factfade.operators.visibility import active_events, active_observations, spread_nulls
from factfade.session import at, materialize

# What a fact gets when it says nothing.
DEFAULT_SOURCE = "user"
DEFAULT_CONFIDENCE = 1.0

# Facts this close in their numbering share a slice when types are carried forward.
_SLICE = 1024


def _max_id(table: DataFrame) -> Column:
    return F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0).cast("long"))


def _problem(field: str, bad: Column, reason: str) -> Column:
    return F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))


def _rejects(rows: DataFrame, keys: list[str], problems: list[Column]) -> DataFrame:
    """(keys.., field, reason), one row per problem."""
    found = F.filter(F.array(*problems), lambda p: p.isNotNull())
    return rows.select(*keys, F.explode(found).alias("p")).select(*keys, "p.field", "p.reason")


def fact_problems(facts: DataFrame, keys: list[str]) -> DataFrame:
    confidence = F.col("confidence")
    # NaN is above every number in Spark's ordering, infinity above 1.
    outside = confidence.isNotNull() & ((confidence < 0) | (confidence > 1))
    return _rejects(
        facts, keys,
        [
            _problem("entity", is_blank(F.col("entity")), "is blank"),
            _problem("observation", is_blank(F.col("observation")), "is blank"),
            _problem("confidence", outside, "lies outside 0 to 1"),
        ],
    )


def validate_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of batches without a bad fact, and the rejects with a reason.

    Rejects name the field as ``facts[seq].field``.
    """
    rejects = fact_problems(facts, ["batch_id", "seq"]).withColumn(
        "field", F.concat(F.lit("facts["), F.col("seq").cast("string"), F.lit("]."), F.col("field"))
    )
    good = facts.join(rejects.select("batch_id").distinct(), "batch_id", "left_anti")
    return good, rejects


def validate_relations(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that may be written, and the rejects.  Both ends must differ."""
    same = F.lower(trim_white(F.col("from"))) == F.lower(trim_white(F.col("to")))
    problems = [
        _problem(name, is_blank(F.col(name)), "is blank")
        for name in ("from", "to", "relation_type")
    ]
    blank = reduce(lambda a, b: a | b, [is_blank(F.col(n)) for n in ("from", "to", "relation_type")])
    problems.append(_problem("to", ~blank & same, "both ends are the same"))
    rejects = _rejects(edges, ["seq"], problems)
    return edges.join(rejects.select("seq").distinct(), "seq", "left_anti"), rejects


def upsert_entities(
    entities: DataFrame, names: DataFrame, order: list[str], as_of
) -> tuple[DataFrame, DataFrame]:
    """Entities after a batch of names, and name key -> id with the type before.

    ``names`` is (name, entity_type, *order).  Known names (any ASCII case) keep
    their spelling; deleted ones come back; the last given type wins.
    """
    key = ascii_lower(F.col("name")).alias("key")
    kind = none_if_empty(F.col("entity_type"))
    moment = F.struct(*[F.col(c) for c in order])
    batch = materialize(
        names.select(key, "name", kind.alias("kind"), moment.alias("moment"))
        .groupBy("key")
        .agg(
            F.min_by("name", "moment").alias("first_name"),
            F.min("moment").alias("first_seen"),
            F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("moment"))).alias("last_kind"),
            F.min("kind").alias("low_kind"), F.max("kind").alias("high_kind"),
        ),
        "names",
    )
    known = entities.withColumn("key", ascii_lower(F.col("name"))).join(
        batch.select("key", "last_kind", "low_kind", "high_kind", F.lit(True).alias("named")),
        "key", "left",
    )
    # Some given type differs from the present one exactly if the smallest or
    # the largest does.
    other = F.coalesce(
        ~F.col("low_kind").eqNullSafe(F.col("entity_type"))
        | ~F.col("high_kind").eqNullSafe(F.col("entity_type")),
        F.lit(False),
    ) & F.col("low_kind").isNotNull()
    changed = F.coalesce("named", F.lit(False)) & (F.col("deleted_at").isNotNull() | other)
    updated = known.select(
        "id", "name",
        F.when(changed, F.coalesce("last_kind", "entity_type")).otherwise(F.col("entity_type"))
        .alias("entity_type"),
        F.when(~changed, F.col("deleted_at")).alias("deleted_at"),
        "created_at",
        F.when(changed, at(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    present = entities.select(
        ascii_lower(F.col("name")).alias("key"), "id", F.col("entity_type").alias("kind_before")
    ).join(batch.select("key"), "key", "left_semi")
    new = number_rows(
        batch.join(present.select("key"), "key", "left_anti")
        .select("key", "first_name", "first_seen", "last_kind"),
        [F.col("first_seen")], "_no",
    ).withColumn("id", _max_id(entities) + F.col("_no"))
    inserted = new.select(
        "id", F.col("first_name").alias("name"), F.col("last_kind").alias("entity_type"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        at(as_of).alias("created_at"), at(as_of).alias("updated_at"),
    )
    ids = present.unionByName(
        new.select("key", "id", F.lit(None).cast("string").alias("kind_before"))
    )
    return updated.unionByName(inserted), ids


def add_observations(
    mem: Memory, facts: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """New observation rows, and (batch_id, seq, entity_id, obs_id, inserted) of all facts.

    ``facts`` is (batch_id, seq, entity_id, entity_type, observation, source,
    confidence, event_id); events are known to be live.  A content that is
    already active on its entity returns the id it has.
    """
    order = F.struct("batch_id", "seq")
    keyed = materialize(facts.withColumn("digest", digest(F.col("observation"))), "facts")
    wanted = keyed.select("entity_id", "digest").distinct()
    own = mem.observations.join(keyed.select("entity_id").distinct(), "entity_id", "left_semi")
    known = (
        active_observations(own, mem.events, as_of)
        .select("id", "entity_id", digest(F.col("content")).alias("digest"))
        .join(wanted, ["entity_id", "digest"], "left_semi")
        .groupBy("entity_id", "digest").agg(F.min("id").alias("known_id"))
    )
    first = keyed.groupBy("entity_id", "digest").agg(F.min(order).alias("first"))
    new = number_rows(
        first.join(known, ["entity_id", "digest"], "left_anti"), [F.col("first")], "_no"
    ).select(
        "entity_id", "digest", "first", (_max_id(mem.observations) + F.col("_no")).alias("new_id")
    )
    new = materialize(new, "new-ids")
    placed = (
        keyed.join(known, ["entity_id", "digest"], "left").join(new, ["entity_id", "digest"], "left")
        .withColumn("inserted", F.coalesce(order == F.col("first"), F.lit(False)))
        .withColumn("obs_id", F.coalesce("new_id", "known_id"))
    )
    none = lambda kind: F.lit(None).cast(kind)
    rows = placed.filter("inserted").select(
        F.col("obs_id").alias("id"), "entity_id", F.col("observation").alias("content"),
        F.coalesce(none_if_empty(F.col("source")), F.lit(DEFAULT_SOURCE)).alias("source"),
        F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.lit(0).cast("long").alias("access_count"), none("timestamp_ntz").alias("last_accessed"),
        F.col("event_id").cast("long").alias("event_id"), "entity_type",
        none("timestamp_ntz").alias("deleted_at"), none("long").alias("superseded_by"),
        none("timestamp_ntz").alias("superseded_at"), none("string").alias("superseded_reason"),
        none("long").alias("superseded_by_run"), at(as_of).alias("created_at"),
    )
    result = placed.select("batch_id", "seq", "entity_id", "obs_id", "inserted")
    return rows, result


def _batched(facts: DataFrame) -> DataFrame:
    """Facts with all columns; a batch number if there is none; ids <= 0 are no event."""
    for name, kind in (
        ("batch_id", "long"), ("entity_type", "string"), ("source", "string"),
        ("confidence", "double"), ("event_id", "long"),
    ):
        if name not in facts.columns:
            default = F.lit(0) if name == "batch_id" else F.lit(None)
            facts = facts.withColumn(name, default.cast(kind))
    return facts.select(
        "batch_id", "seq", "entity", none_if_empty(F.col("entity_type")).alias("entity_type"),
        "observation", "source", "confidence",
        F.when(F.col("event_id") > 0, F.col("event_id")).alias("event_id"),
    )


def dead_event_facts(facts: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Facts whose event does not exist or has ended."""
    live = active_events(mem.events, as_of).select(F.col("id").alias("event_id"))
    return facts.filter(F.col("event_id").isNotNull()).join(live, "event_id", "left_anti")


def _store(mem: Memory, facts: DataFrame, as_of) -> tuple[Memory, DataFrame, DataFrame, DataFrame]:
    """Entities and observations after facts that are known to be good."""
    facts = materialize(facts, "batch")
    order = ["batch_id", "seq"]
    names = facts.select(F.col("entity").alias("name"), "entity_type", *order)
    entities, ids = upsert_entities(mem.entities, names, order, as_of)
    ids = materialize(ids, "ids")
    owned = facts.withColumn("key", ascii_lower(F.col("entity"))).join(
        ids.withColumnRenamed("id", "entity_id"), "key"
    )
    slices = F.struct("batch_id", F.floor(F.col("seq") / _SLICE).alias("slice"))
    typed = with_previous(owned, ["key"], slices, order, F.col("entity_type")).withColumn(
        "entity_type", F.coalesce("entity_type", "previous", "kind_before")
    )
    rows, result = add_observations(
        mem, typed.select(
            "batch_id", "seq", "entity_id", "entity_type", "observation", "source", "confidence",
            "event_id",
        ), as_of,
    )
    after = mem.with_tables(
        entities=entities,
        observations=mem.observations.unionByName(rows.select(*mem.observations.columns)),
    )
    return after, entities, rows, result


def remember_batch(mem: Memory, facts: DataFrame, as_of) -> Write:
    """Facts (batch_id, seq, entity, observation, ..) written batch by batch in order.

    One bad fact, or one whose event is not live, keeps its whole batch out.
    """
    facts = _batched(facts)
    good, rejects = validate_facts(facts)
    dead = dead_event_facts(good, mem, as_of)
    good = good.join(dead.select("batch_id").distinct(), "batch_id", "left_anti")
    after, entities, rows, result = _store(mem, good, as_of)
    return Write(
        after, result, appended={"observations": rows}, rewritten={"entities": entities}
    )


def rejected_facts(mem: Memory, facts: DataFrame, as_of) -> DataFrame:
    """(batch_id, seq, field, reason) of everything that keeps a batch out."""
    good, rejects = validate_facts(_batched(facts))
    dead = dead_event_facts(good, mem, as_of).select(
        "batch_id", "seq",
        F.concat(F.lit("facts["), F.col("seq").cast("string"), F.lit("].event_id")).alias("field"),
        F.lit("event not found or expired").alias("reason"),
    )
    return rejects.unionByName(dead)


def remember_event(mem: Memory, events: DataFrame, facts: DataFrame, as_of) -> Write:
    """New events with the facts attached to them; each event is taken whole or not at all.

    ``events`` is (event_no, label, event_date, event_type, context, expires_at
    text), ``facts`` (event_no, seq, entity, observation, ..).  The result has one
    row per created event.
    """
    ends = parse_expiry(F.col("expires_at"))
    given = ~is_blank(F.col("expires_at"))
    problems = _rejects(
        events, ["event_no"],
        [
            _problem("label", is_blank(F.col("label")), "is blank"),
            _problem("expires_at", given & ends.isNull(), "not a timestamp"),
        ],
    ).select("event_no")
    facts = _batched(
        facts.withColumnRenamed("event_no", "batch_id").drop("event_id")
    )
    bad_facts = fact_problems(facts, ["batch_id"]).select(F.col("batch_id").alias("event_no"))
    # Facts cannot be attached to an event that has ended already.
    ended = events.filter(given & (ends <= at(as_of))).select("event_no").join(
        facts.select(F.col("batch_id").alias("event_no")).distinct(), "event_no", "left_semi"
    )
    refused = problems.unionByName(bad_facts).unionByName(ended).distinct()
    accepted = materialize(
        number_rows(
            events.join(refused, "event_no", "left_anti"), [F.col("event_no")], "_no"
        ).select(
            "event_no", (_max_id(mem.events) + F.col("_no")).alias("id"), "label",
            none_if_empty(F.col("event_date")).alias("event_date"),
            none_if_empty(F.col("event_type")).alias("event_type"),
            none_if_empty(F.col("context")).alias("context"),
            F.when(given, ends).alias("expires_at"), at(as_of).alias("created_at"),
        ),
        "events",
    )
    new_events = accepted.drop("event_no").select(*mem.events.columns)
    state = mem.with_tables(events=mem.events.unionByName(new_events))
    attached = facts.drop("event_id").join(
        accepted.select(F.col("event_no").alias("batch_id"), F.col("id").alias("event_id")), "batch_id"
    )
    after, entities, rows, stored = _store(state, attached, as_of)
    counts = stored.groupBy(F.col("batch_id").alias("event_no")).agg(
        F.count(F.lit(1)).alias("observations_attached")
    )
    result = accepted.select("event_no", F.col("id").alias("event_id"), "label").join(
        counts, "event_no", "left"
    ).withColumn("observations_attached", F.coalesce("observations_attached", F.lit(0)))
    return Write(
        after, result, appended={"observations": rows, "events": new_events},
        rewritten={"entities": entities},
    )


def relate(mem: Memory, edges: DataFrame, as_of) -> Write:
    """Edges (seq, from, to, relation_type, context): ends are upserted, known edges kept.

    The first context of an edge wins.  Each edge stands for itself: bad ones are
    left out.  Result: (seq, created).
    """
    good, _ = validate_relations(edges)
    good = materialize(good, "edges")
    names = good.select(
        F.col("from").alias("name"), F.lit(None).cast("string").alias("entity_type"), "seq",
        F.lit(0).alias("end"),
    ).unionByName(
        good.select(
            F.col("to").alias("name"), F.lit(None).cast("string").alias("entity_type"), "seq",
            F.lit(1).alias("end"),
        )
    )
    entities, ids = upsert_entities(mem.entities, names, ["seq", "end"], as_of)
    ids = materialize(ids.select("key", "id"), "ids")
    end = lambda name, to: ids.select(F.col("key").alias(name), F.col("id").alias(to))
    keys = ["from_entity_id", "to_entity_id", "relation_type"]
    resolved = (
        good.withColumn("_from", ascii_lower(F.col("from"))).withColumn("_to", ascii_lower(F.col("to")))
        .join(end("_from", "from_entity_id"), "_from").join(end("_to", "to_entity_id"), "_to")
        .select("seq", *keys, none_if_empty(F.col("context")).alias("context"))
    )
    first = resolved.groupBy(*keys).agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("context"), "seq").alias("said")
    )
    new = materialize(
        number_rows(
            first.join(mem.relations.select(*keys), keys, "left_anti"), [F.col("seq")], "_no"
        ).select(
            (_max_id(mem.relations) + F.col("_no")).alias("id"), *keys,
            F.col("said.context").alias("context"), at(as_of).alias("created_at"), "seq",
        ),
        "relations",
    )
    rows = new.drop("seq").select(*mem.relations.columns)
    result = good.select("seq").join(
        new.select("seq", F.lit(True).alias("created")), "seq", "left"
    ).withColumn("created", F.coalesce("created", F.lit(False)))
    after = mem.with_tables(entities=entities, relations=mem.relations.unionByName(rows))
    return Write(after, result, appended={"relations": rows}, rewritten={"entities": entities})


def forgotten_rows(mem: Memory, ids: DataFrame) -> DataFrame:
    """(id, owner_live) of the asked rows that are not deleted yet."""
    owners = mem.entities.select(
        F.col("id").alias("entity_id"), F.col("deleted_at").isNull().alias("owner_live")
    )
    return (
        mem.observations.filter(F.col("deleted_at").isNull()).select("id", "entity_id")
        .join(ids, "id", "left_semi").join(owners, "entity_id").select("id", "owner_live")
    )


def forget_observations(mem: Memory, ids: DataFrame, as_of) -> Write:
    """Rows marked deleted and their vectors dropped; result (id, deleted).

    A row of a deleted entity is cleaned up too, but the answer is no.
    """
    ids = ids.select("id").distinct()
    hit = forgotten_rows(mem, ids)
    result = ids.join(hit, "id", "left").select(
        "id", F.coalesce("owner_live", F.lit(False)).alias("deleted")
    )
    observations = _mark_deleted(mem.observations, hit.select("id"), as_of)
    after, rewritten = _without_vectors(mem, observations, ids)
    return Write(after, result, rewritten=rewritten)


def _mark_deleted(observations: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    marks = ids.select("id", F.lit(True).alias("_hit"))
    return (
        observations.join(marks, "id", "left")
        .withColumn(
            "deleted_at",
            F.coalesce("deleted_at", F.when(F.col("_hit"), at(as_of))),
        )
        .select(*observations.columns)
    )


def _without_vectors(
    mem: Memory, observations: DataFrame, ids: DataFrame, **tables: DataFrame
) -> tuple[Memory, dict[str, DataFrame]]:
    rewritten = {"observations": observations, **tables}
    if mem.embeddings is not None:
        rewritten["embeddings"] = mem.embeddings.join(
            ids.select(F.col("id").alias("observation_id")), "observation_id", "left_anti"
        )
    return mem.with_tables(**rewritten), rewritten


def forget_entities(mem: Memory, names: DataFrame, as_of) -> Write:
    """Entities by name marked deleted with all their rows; edges and vectors are dropped.

    Result (name, deleted).  For an entity deleted before, leftovers are cleaned
    up and the answer is no.
    """
    asked = names.select("name", ascii_lower(F.col("name")).alias("key")).distinct()
    found = mem.entities.withColumn("key", ascii_lower(F.col("name"))).join(
        asked.select("key").distinct(), "key", "left_semi"
    ).select("key", "id", F.col("deleted_at").isNull().alias("was_live"))
    result = asked.join(found, "key", "left").select(
        "name", F.coalesce("was_live", F.lit(False)).alias("deleted")
    )
    gone = found.select("id")
    own = mem.observations.select("id", "entity_id").join(
        gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi"
    ).select("id")
    marks = gone.withColumn("_hit", F.lit(True))
    dying = F.col("_hit") & F.col("deleted_at").isNull()
    entities = (
        mem.entities.join(marks, "id", "left")
        .withColumn("updated_at", F.when(dying, at(as_of)).otherwise(F.col("updated_at")))
        .withColumn("deleted_at", F.when(dying, at(as_of)).otherwise(F.col("deleted_at")))
        .select(*mem.entities.columns)
    )
    tables = {"entities": entities}
    if mem.relations is not None:
        tables["relations"] = (
            mem.relations
            .join(gone.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_anti")
            .join(gone.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_anti")
            .select(*mem.relations.columns)
        )
    observations = (
        mem.observations.join(gone.select(F.col("id").alias("entity_id"), F.lit(True).alias("_hit")),
                              "entity_id", "left")
        .withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_hit"), at(as_of))))
        .select(*mem.observations.columns)
    )
    after, rewritten = _without_vectors(mem, observations, own, **tables)
    return Write(after, result, rewritten=rewritten)


def remember(mem: Memory, facts: DataFrame, as_of, half_life) -> tuple[Write, DataFrame]:
    """Single facts, each for itself, with hints on rows they may contradict.

    All facts of the job see the state before it.  Returns the write and the
    hints (seq, rank, obs_id, similarity, snippet).
    """
    facts = _batched(facts).withColumn("batch_id", F.col("seq"))
    good, _ = validate_facts(facts)
    dead = dead_event_facts(good, mem, as_of)
    good = materialize(good.join(dead.select("seq"), "seq", "left_anti"), "facts")
    after, entities, rows, result = _store(mem, good, as_of)
    # Every step of the hints reads the entities: they are worked out once.
    entities = materialize(entities, "entities")
    result = materialize(result, "stored")
    after = after.with_tables(entities=entities)
    owned = good.select("seq", F.col("observation").alias("content")).join(
        result.select("seq", "entity_id"), "seq"
    )
    # Rows of an entity that this write brings back are visible to its hints.
    hints = conflict_hints(owned, mem.with_tables(entities=entities), as_of, half_life)
    write = Write(
        after, result, appended={"observations": rows}, rewritten={"entities": entities}
    )
    return write, hints
