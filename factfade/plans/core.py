"""Tables, predicates, joins, counts and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.functions import scoring, text, times
from factfade.operators import integrity, search, views, visibility
from factfade.plans import inputs
from factfade.plans.inputs import AS_OF
from factfade.plans.oracle_views import NOW, ascii_lower, clean, decayed, memory, only, tokens
from factfade.plans.registry import num, query, ts
from factfade.session import scratch_path
from factfade.sources import shape, store

HL = 12

# -- tables ---------------------------------------------------------------


@query(
    "load_memory",
    memory("doc") + """
SELECT 'entities' AS "table", id, length(name) AS size FROM ent
UNION ALL SELECT 'observations', id, length(content) FROM obs
UNION ALL SELECT 'events', id, length(label) FROM ev""",
)
def load_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "store")
    store.publish(spark, root, "global", inputs.memory(spark, sf_dir), expected=0)
    mem = store.load_memory(spark, root, "global")
    row = lambda df, name, c: df.select(
        F.lit(name).alias("table"), "id", F.char_length(c).alias("size")
    )
    return (
        row(mem.entities, "entities", "name")
        .unionByName(row(mem.observations, "observations", "content"))
        .unionByName(row(mem.events, "events", "label"))
    )


@query(
    "conform_schema",
    memory("doc") + f"""
SELECT id, entity_id, content, 'user' AS source, confidence, CAST(0 AS BIGINT) AS access_count,
       CAST(NULL AS BIGINT) AS event_id, {ts('created_at')} AS created_at
FROM obs""",
)
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = inputs.observations(spark, sf_dir).select(
        "id", "entity_id", "content", "confidence", "created_at"
    )
    return shape.conform_schema(old, "observations", AS_OF).select(
        "id", "entity_id", "content", "source", "confidence", "access_count", "event_id", "created_at"
    )


_PROJECTS = """
SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('/srv/', source)
  WHEN 2 THEN '~' WHEN 3 THEN concat('~/', source) WHEN 4 THEN concat('work//', source, '/')
  ELSE concat('./', source, '/../x') END AS project FROM documents"""


@query(
    "route_scope",
    f"""
SELECT doc_id, project,
       CASE doc_id % 6 WHEN 0 THEN 'global' WHEN 1 THEN concat('/srv/', source) WHEN 2 THEN '/home/me'
         WHEN 3 THEN concat('/home/me/', source) WHEN 4 THEN concat('/home/me/work/', source)
         ELSE '/home/me/x' END AS scope,
       CASE WHEN doc_id % 6 = 0 THEN 12.0 ELSE 52.0 END::DOUBLE AS half_life
FROM ({_PROJECTS}) p""",
)
def route_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 6
    projects = inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d == 0, "").when(d == 1, F.concat(F.lit("/srv/"), "source")).when(d == 2, "~")
        .when(d == 3, F.concat(F.lit("~/"), "source"))
        .when(d == 4, F.concat(F.lit("work//"), "source", F.lit("/")))
        .otherwise(F.concat(F.lit("./"), "source", F.lit("/../x"))).alias("project"),
    )
    return shape.route_scope(projects, "/home/me")


@query(
    "snapshot_export",
    memory("doc") + """
SELECT 'entities' AS "table", count(*) AS "rows" FROM ent
UNION ALL SELECT 'observations', count(*) FROM obs
UNION ALL SELECT 'events', count(*) FROM ev
UNION ALL SELECT 'relations', 0""",
)
def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = scratch_path(spark, "snapshot")
    return store.snapshot_export(inputs.memory(spark, sf_dir), dest, AS_OF).drop("path")


@query(
    "integrity_violations",
    memory("doc") + f"""
SELECT 'orphan_event' AS rule, 'observations' AS "table", id FROM obs
  WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM ev)
UNION ALL SELECT 'orphan_entity', 'observations', id FROM obs WHERE entity_id NOT IN (SELECT id FROM ent)
UNION ALL SELECT 'orphan_target', 'observations', id FROM obs
  WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM obs)
UNION ALL SELECT 'duplicate_name', 'entities', id FROM (
  SELECT id, row_number() OVER (PARTITION BY {ascii_lower('name')} ORDER BY id) AS rn FROM ent) WHERE rn > 1""",
)
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.integrity_violations(inputs.memory(spark, sf_dir))


@query(
    "parse_facts",
    """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(0 AS BIGINT) AS fact_no, role AS entity, text AS observation,
       CASE WHEN turn % 2 = 0 THEN 0.5 END AS confidence,
       CASE WHEN turn % 5 = 4 THEN 'rejected' ELSE 'fact' END AS kind
FROM conversations WHERE turn % 5 <> 4
UNION ALL SELECT conv_id, turn, CASE WHEN turn % 10 = 4 THEN 0 END, NULL, NULL, NULL, 'rejected'
FROM conversations WHERE turn % 5 = 4""",
)
def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    json = F.to_json(
        F.struct(
            F.col("role").alias("entity"), F.col("text").alias("observation"),
            F.when(turn % 2 == 0, 0.5).alias("confidence"),
        )
    )
    lines = inputs.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(turn % 10 == 4, '{"entity": 7, "observation": "x"}').when(turn % 10 == 9, "no json")
        .when(turn % 2 == 1, F.concat(F.lit("["), json, F.lit("]"))).otherwise(json).alias("line"),
    )
    good, bad = shape.parse_facts(lines, "line")
    columns = ["conv_id", "turn", "fact_no", "entity", "observation", "confidence", "kind"]
    nothing = [inputs.nothing(k).alias(n) for n, k in (
        ("entity", "string"), ("observation", "string"), ("confidence", "double"))]
    return good.withColumn("kind", F.lit("fact")).select(*columns).unionByName(
        bad.select("conv_id", "turn", "fact_no", *nothing, F.lit("rejected").alias("kind"))
    )


# -- predicates -----------------------------------------------------------


@query("active_events", memory("doc") + f"SELECT id, label, {ts('expires_at')} AS expires_at FROM lev")
def active_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.active_events(inputs.events(spark, sf_dir), AS_OF).select(
        "id", "label", "expires_at"
    )


@query(
    "active_events_as_of",
    memory("doc") + """
SELECT id, label FROM ev WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 23:00:00'""",
)
def active_events_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The instant at which a fifth of the events end: they count as ended.
    return visibility.active_events(inputs.events(spark, sf_dir), "2024-01-31 23:00:00").select(
        "id", "label"
    )


@query("active_observations", memory("doc") + "SELECT id, entity_id, event_id, content FROM act")
def active_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir)
    return visibility.active_observations(mem.observations, mem.events, AS_OF).select(
        "id", "entity_id", "event_id", "content"
    )


@query("live_observations", memory("doc") + "SELECT id, entity_id, event_id, content FROM liv")
def live_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.live_observations(inputs.memory(spark, sf_dir), AS_OF).select(
        "id", "entity_id", "event_id", "content"
    )


@query(
    "literal_contains",
    f"""SELECT doc_id, contains({ascii_lower('text')}, '|') AS has_bar,
contains({ascii_lower('text')}, '%') AS has_percent, contains({ascii_lower('text')}, '_') AS has_underscore,
contains({ascii_lower('text')}, 'the ') AS has_word FROM documents""",
)
def literal_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", text.literal_contains(c, "|").alias("has_bar"),
        text.literal_contains(c, "%").alias("has_percent"),
        text.literal_contains(c, "_").alias("has_underscore"),
        text.literal_contains(c, "THE ").alias("has_word"),
    )


@query(
    "event_filters",
    memory("doc") + """
SELECT id, label, event_type, event_date FROM ev
WHERE contains(label, 'conversation 1') AND event_type = 'chat'
  AND event_date >= '2024-01-05' AND event_date <= '2024-01-20T10:00'""",
)
def event_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.event_filters(
        inputs.events(spark, sf_dir), "Conversation 1", "chat", "2024-01-05", "2024-01-20T10:00"
    ).select("id", "label", "event_type", "event_date")


@query("entity_type_filter", memory("doc") + "SELECT id, name FROM ent WHERE entity_type = 'feed'")
def entity_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.entity_type_filter(inputs.entities(spark, sf_dir), "feed").select("id", "name")


# -- joins ----------------------------------------------------------------


@query(
    "hydrate",
    memory("doc") + f"""
SELECT l.id AS obs_id, l.entity_id, e.name AS entity_name, e.entity_type, l.content, l.source,
       {num('l.confidence')} AS stored_confidence, l.access_count, {ts('l.created_at')} AS created_at,
       l.event_id, lev.label AS event_label, lev.event_date, lev.event_type
FROM liv l JOIN ent e ON e.id = l.entity_id LEFT JOIN lev ON lev.id = l.event_id""",
)
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir)
    return search.hydrate(mem.observations.select(F.col("id").alias("obs_id")), mem, AS_OF)


_REQUESTS = """
req AS (SELECT doc_id % 7 AS req_id, doc_id AS pos,
        (doc_id * 13) % (SELECT max(doc_id) + 42 FROM documents) - 20 AS id FROM documents)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asks for some id; ids repeat, are missing or not positive."""
    d, docs = F.col("doc_id"), inputs.table(spark, sf_dir, "documents")
    span = docs.agg(F.max("doc_id") + 42).scalar()
    return docs.select((d % 7).alias("req_id"), d.alias("pos"), ((d * 13) % span - 20).alias("id"))


@query(
    "observations_by_id",
    memory("doc") + f""", {_REQUESTS.strip()},
uniq AS (SELECT req_id, id, min(pos) AS pos FROM req WHERE id > 0 GROUP BY req_id, id)
SELECT u.req_id, u.pos, l.id, l.entity_id, e.name AS entity_name, l.entity_type, l.content, l.source,
       {num('l.confidence')} AS stored_confidence, {num(decayed('l.'))} AS confidence,
       l.access_count, {ts('CAST(NULL AS TIMESTAMP)')} AS last_accessed, {ts('l.created_at')} AS created_at, l.event_id,
       v.label AS event_label, v.event_date, v.event_type
FROM uniq u JOIN liv l ON l.id = u.id JOIN ent e ON e.id = l.entity_id LEFT JOIN ev v ON v.id = l.event_id""",
)
def observations_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.observations_by_id(
        _requests(spark, sf_dir), inputs.memory(spark, sf_dir), AS_OF, HL
    )


@query(
    "request_totals",
    memory("doc") + f""", {_REQUESTS.strip()},
uniq AS (SELECT DISTINCT req_id, id FROM req WHERE id > 0)
SELECT u.req_id, count(*) AS requested, count(l.id) AS total
FROM uniq u LEFT JOIN liv l ON l.id = u.id GROUP BY u.req_id""",
)
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir)
    found = views.observations_by_id(asked, inputs.memory(spark, sf_dir), AS_OF, HL)
    return views.request_totals(asked, found)


def _edges(near: str, far: str) -> str:
    return memory("graph", "m_relations") + f"""
SELECT r.{near} AS entity_id, r.id, r.relation_type, e.name AS other_name, e.entity_type AS other_type
FROM m_relations r JOIN ent e ON e.id = r.{far} WHERE e.deleted_at IS NULL"""


@query("relations_outgoing", _edges("from_entity_id", "to_entity_id"))
def relations_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.relations_of(inputs.graph_memory(spark, sf_dir), "outgoing").select(
        "entity_id", "id", "relation_type", "other_name", "other_type"
    )


@query("relations_incoming", _edges("to_entity_id", "from_entity_id"))
def relations_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.relations_of(inputs.graph_memory(spark, sf_dir), "incoming").select(
        "entity_id", "id", "relation_type", "other_name", "other_type"
    )


# -- counts and lists -----------------------------------------------------


@query(
    "observation_counts",
    memory("doc") + "SELECT entity_id, count(*) AS observation_count FROM act GROUP BY entity_id",
)
def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.observation_counts(inputs.memory(spark, sf_dir), AS_OF)


@query(
    "relation_counts",
    memory("graph", "m_relations") + """
SELECT entity_id, count(*) AS relation_count FROM (
  SELECT from_entity_id AS entity_id FROM m_relations UNION ALL SELECT to_entity_id FROM m_relations) x
GROUP BY entity_id""",
)
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.relation_counts(inputs.graph_memory(spark, sf_dir))


_LIST = """
SELECT e.id, e.name, e.entity_type, {created} AS created_at, {updated} AS updated_at,
       coalesce(n, 0) AS observation_count
FROM ent e LEFT JOIN (SELECT entity_id, count(*) AS n FROM act GROUP BY entity_id) a ON a.entity_id = e.id
{edges} WHERE e.deleted_at IS NULL AND (coalesce(n, 0) > 0 {or_edges}) {more}
ORDER BY e.updated_at DESC, e.id LIMIT 50"""


@query(
    "list_entities",
    memory("doc") + _LIST.format(
        created=ts("e.created_at"), updated=ts("e.updated_at"), edges="", or_edges="",
        more="AND e.entity_type = 'feed'",
    ),
)
def list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_entities(inputs.memory(spark, sf_dir), AS_OF, "feed")


@query(
    "list_entities_with_edges",
    memory("graph", "m_relations") + _LIST.format(
        created=ts("e.created_at"), updated=ts("e.updated_at"),
        edges="""LEFT JOIN (SELECT entity_id, count(*) AS m FROM (
          SELECT from_entity_id AS entity_id FROM m_relations UNION ALL SELECT to_entity_id FROM m_relations) x
          GROUP BY entity_id) r ON r.entity_id = e.id""",
        or_edges="OR coalesce(m, 0) > 0", more="",
    ),
)
def list_entities_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_entities(inputs.graph_memory(spark, sf_dir), AS_OF)


@query(
    "event_counts",
    memory("turn") + f"""
SELECT v.id, v.label, v.event_date, v.event_type, v.context, {ts('v.expires_at')} AS expires_at,
       {ts('v.created_at')} AS created_at, count(l.id) AS observation_count
FROM lev v LEFT JOIN liv l ON l.event_id = v.id
WHERE v.event_date >= '2024-01-02' GROUP BY ALL
ORDER BY v.event_date DESC, v.created_at DESC, v.id LIMIT 20""".replace("GROUP BY ALL", "GROUP BY v.id, v.label, v.event_date, v.event_type, v.context, v.expires_at, v.created_at"),
)
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_counts(inputs.turn_memory(spark, sf_dir), AS_OF, date_from="2024-01-02")


@query(
    "observation_totals",
    memory("doc") + """
SELECT count(*) AS total, count(deleted_at) AS deleted, count(superseded_by) AS superseded,
       (SELECT count(*) FROM act) AS active FROM obs""",
)
def observation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.observation_totals(inputs.memory(spark, sf_dir), AS_OF)


# -- views ----------------------------------------------------------------


@query(
    "entity_graph",
    memory("graph", "m_relations") + f"""
SELECT e.id AS entity_id, e.name AS entity_name, e.entity_type AS entity_kind, 'observation' AS section, a.id,
       a.content, {num('a.confidence')} AS stored_confidence, {num(decayed('a.'))} AS confidence,
       {ts('a.created_at')} AS created_at, v.label AS event_label, a.entity_type AS row_type,
       NULL AS relation_type, NULL AS other_name, NULL AS other_type
FROM ent e JOIN act a ON a.entity_id = e.id LEFT JOIN ev v ON v.id = a.event_id WHERE e.deleted_at IS NULL
UNION ALL SELECT e.id, e.name, e.entity_type, 'outgoing', r.id, NULL, NULL, NULL, '2023-01-01 00:00:00.000000',
       NULL, NULL, r.relation_type, o.name, o.entity_type
FROM ent e JOIN m_relations r ON r.from_entity_id = e.id JOIN ent o ON o.id = r.to_entity_id
UNION ALL SELECT e.id, e.name, e.entity_type, 'incoming', r.id, NULL, NULL, NULL, '2023-01-01 00:00:00.000000',
       NULL, NULL, r.relation_type, o.name, o.entity_type
FROM ent e JOIN m_relations r ON r.to_entity_id = e.id JOIN ent o ON o.id = r.from_entity_id""",
)
def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.graph_memory(spark, sf_dir)
    names = mem.entities.select(F.lower("name").alias("name"))
    return views.entity_graph(names, mem, AS_OF, HL)


@query(
    "full_event",
    memory("turn") + f""",
seen AS (SELECT l.*, e.name AS entity_name, e.entity_type AS owner_type FROM liv l JOIN ent e ON e.id = l.entity_id),
grp AS (SELECT event_id, entity_name, min(created_at) AS first_at, count(*) AS n FROM seen GROUP BY event_id, entity_name),
tot AS (SELECT event_id, CAST(sum(n) AS BIGINT) AS total FROM grp GROUP BY event_id)
SELECT v.id AS event_id, v.label AS event_label, v.event_date, v.event_type, v.context,
       {ts('v.expires_at')} AS expires_at, coalesce(tot.total, 0) AS total_observations,
       s.entity_name, s.owner_type AS entity_type, s.id, s.content, s.source, s.access_count,
       {ts('s.created_at')} AS created_at, {num(decayed('s.'))} AS confidence, g.n AS group_size,
       {ts('g.first_at')} AS group_first_at
FROM lev v LEFT JOIN tot ON tot.event_id = v.id LEFT JOIN seen s ON s.event_id = v.id
LEFT JOIN grp g ON g.event_id = s.event_id AND g.entity_name = s.entity_name""",
)
def full_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.turn_memory(spark, sf_dir)
    return views.full_event(mem.events.select(F.col("id").alias("event_id")), mem, AS_OF, HL)


@query(
    "event_observations",
    memory("turn") + f"""
SELECT l.event_id, l.id, e.name AS entity_name, l.content, {num('l.confidence')} AS stored_confidence,
       {num(decayed('l.'))} AS confidence, {ts('l.created_at')} AS created_at, v.label AS event_label
FROM liv l JOIN ent e ON e.id = l.entity_id JOIN lev v ON v.id = l.event_id""",
)
def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.turn_memory(spark, sf_dir)
    return views.event_observations(
        mem.events.select(F.col("id").alias("event_id")), mem, AS_OF, HL
    ).select(
        "event_id", "id", "entity_name", "content", "stored_confidence", "confidence", "created_at",
        "event_label",
    )


@query(
    "chronological_event_rows",
    memory("turn") + f"""
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY created_at, id) AS place, id,
       {ts('created_at')} AS created_at FROM liv WHERE event_id IS NOT NULL""",
)
def chronological_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in its event, from distributed numbering."""
    from factfade.operators.ordering import number_rows

    mem = inputs.turn_memory(spark, sf_dir)
    rows = visibility.live_observations(mem, AS_OF).filter(F.col("event_id").isNotNull())
    numbered = number_rows(
        rows.select("event_id", "created_at", "id"),
        [F.col("event_id"), F.col("created_at"), F.col("id")], "overall",
    )
    first = numbered.groupBy("event_id").agg(F.min("overall").alias("first"))
    return numbered.join(first, "event_id").select(
        "event_id", (F.col("overall") - F.col("first") + 1).alias("place"), "id", "created_at"
    )


# -- scalar functions -----------------------------------------------------


@query(
    "decayed_confidence",
    memory("doc") + f"""
SELECT id, {num(decayed())} AS global_confidence,
       {num(decayed('', 'confidence', '52.0'))} AS project_confidence FROM obs""",
)
def decayed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("created_at", "confidence", "access_count")]
    return inputs.observations(spark, sf_dir).select(
        "id", scoring.decayed_confidence(*columns, 0, AS_OF).alias("global_confidence"),
        scoring.decayed_confidence(*columns, scoring.HALF_LIFE_PROJECT, AS_OF)
        .alias("project_confidence"),
    )


@query(
    "fts_position_score",
    f"""SELECT doc_id, {num("CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - p / (n - 1)::DOUBLE END")} AS score
FROM (SELECT doc_id, doc_id % 13 AS p, doc_id % 11 AS n FROM documents) d""",
)
def fts_position_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", scoring.fts_position_score(d % 13, d % 11).alias("score")
    )


@query(
    "composite_score",
    f"""
SELECT doc_id, {num('''0.7::DOUBLE * (w + CASE WHEN p IS NULL THEN 0 ELSE 0.08::DOUBLE * (1.0::DOUBLE - p / 12.0::DOUBLE) END
  + least(0.10::DOUBLE, 0.03::DOUBLE * (c - 1))) + 0.3::DOUBLE * m''')} AS score
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.15::DOUBLE ELSE 0.5::DOUBLE END AS w,
             CASE WHEN doc_id % 3 = 0 THEN doc_id % 13 END AS p, doc_id % 6 + 1 AS c,
             (doc_id % 11) / 10.0::DOUBLE AS m FROM documents) d""",
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        scoring.composite_score(
            F.when(d % 2 == 0, 1.15).otherwise(0.5), d % 6 + 1, F.when(d % 3 == 0, d % 13),
            F.lit(13), (d % 11) / 10.0,
        ).alias("score"),
    )


@query(
    "sanitize_limit",
    "SELECT doc_id, CAST(greatest(0, least(200, doc_id % 500 - 100)) AS BIGINT) AS kept FROM documents",
)
def sanitize_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", scoring.sanitize_limit(F.col("doc_id") % 500 - 100).alias("kept")
    )


@query(
    "compact_snippet",
    """SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(substr(text, 1, 119), '…') ELSE text END AS content,
length(text) > 120 AS truncated FROM documents""",
)
def compact_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", text.compact_snippet(F.col("text")).alias("s")
    ).select("doc_id", "s.content", "s.truncated")


@query(
    "truncate_ellipsis",
    """SELECT doc_id, CASE WHEN length(text) > 48 THEN concat(substr(text, 1, 45), '...') ELSE text END AS long_form,
substr(text, 1, 3) AS short_form FROM documents""",
)
def truncate_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", text.truncate_ellipsis(c, 48).alias("long_form"),
        text.truncate_ellipsis(c, 3).alias("short_form"),
    )


@query(
    "parse_timestamp",
    f"""
SELECT event_id, {ts("CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) END")} AS moment,
  {ts("CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts - INTERVAL 2 HOUR) END")} AS expiry
FROM events""",
)
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of the event stream written in five layouts and one bad one."""
    ts_col, k = F.col("ts"), F.col("event_id") % 6
    written = (
        F.when(k == 0, F.date_format(ts_col, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.date_format(ts_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 2, F.date_format(ts_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .when(k == 3, F.date_format(ts_col, "yyyy-MM-dd"))
        .when(k == 4, F.date_format(ts_col, "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format(ts_col, "yyyy"))
    )
    return inputs.table(spark, sf_dir, "events").select("event_id", written.alias("w")).select(
        "event_id", times.parse_timestamp(F.col("w")).alias("moment"),
        times.parse_expiry(F.col("w")).alias("expiry"),
    )


@query(
    "query_terms",
    f"SELECT doc_id, array_to_string({clean('text')}, ' ') AS terms, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text.query_terms(c), " ").alias("terms"),
        F.array_join(text.tokens(c), " ").alias("tokens"),
    )
