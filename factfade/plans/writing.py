"""Writes and the continuous ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.operators import writes
from factfade.plans import inputs, oracle_search
from factfade.plans.inputs import AS_OF
from factfade.plans.oracle_views import NOW, ascii_lower, memory
from factfade.plans.recall import _FACT_OWNERS
from factfade.plans.registry import num, query, ts
from factfade.session import scratch_path
from factfade.sources import store
from factfade.streaming.ingest import ingest_stream

HL = 12

_BAD = """SELECT DISTINCT batch_id FROM m_facts WHERE confidence > 1 OR trim(entity) = '' OR trim(observation) = ''
  OR (event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM lev))"""

# Facts of good batches with the entity, the first equal fact and the type at that time.
_BATCH = f""",
good AS (SELECT *, {ascii_lower('entity')} AS key FROM m_facts WHERE batch_id NOT IN ({_BAD})),
names AS (SELECT key, arg_min(entity, seq) AS name, min(seq) AS first FROM good GROUP BY key),
ids AS (
  SELECT n.key, n.name, coalesce(e.id, (SELECT max(id) FROM ent) + row_number() OVER (PARTITION BY e.id IS NULL ORDER BY n.first)) AS entity_id,
         e.entity_type AS before FROM names n LEFT JOIN ent e ON {ascii_lower('e.name')} = n.key),
typed AS (
  SELECT g.*, i.entity_id, i.before,
    coalesce(last_value(g.entity_type IGNORE NULLS) OVER (PARTITION BY g.key ORDER BY g.seq ROWS UNBOUNDED PRECEDING), i.before) AS kind,
    min(g.seq) OVER (PARTITION BY g.key, g.observation) AS first_seq
  FROM good g JOIN ids i ON i.key = g.key),
known AS (SELECT entity_id, content, min(id) AS known_id FROM act GROUP BY entity_id, content),
fresh AS (
  SELECT t.entity_id, t.observation, t.first_seq, (SELECT max(id) FROM obs) + row_number() OVER (ORDER BY t.first_seq) AS new_id
  FROM typed t LEFT JOIN known k ON k.entity_id = t.entity_id AND k.content = t.observation
  WHERE t.seq = t.first_seq AND k.known_id IS NULL),
done AS (
  SELECT t.*, coalesce(f.new_id, k.known_id) AS obs_id, f.new_id IS NOT NULL AND t.seq = t.first_seq AS inserted
  FROM typed t LEFT JOIN fresh f ON f.entity_id = t.entity_id AND f.observation = t.observation
  LEFT JOIN known k ON k.entity_id = t.entity_id AND k.content = t.observation)"""

_ROWS = f"""
SELECT obs_id AS id, entity_id, observation AS content, 'user' AS source, {num('confidence::DOUBLE')} AS confidence,
       event_id, kind AS entity_type, {ts(NOW)} AS created_at FROM done WHERE inserted"""


@query(
    "valid_facts",
    memory("turn", "m_facts") + """
SELECT batch_id, seq, concat('facts[', seq, '].confidence') AS field, 'lies outside 0 to 1' AS reason
FROM m_facts WHERE confidence > 1
UNION ALL SELECT batch_id, seq, concat('facts[', seq, '].observation'), 'is blank' FROM m_facts WHERE trim(observation) = ''
UNION ALL SELECT batch_id, seq, concat('facts[', seq, '].event_id'), 'event not found or expired'
FROM m_facts WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM lev)
  AND batch_id NOT IN (SELECT batch_id FROM m_facts WHERE confidence > 1 OR trim(observation) = '')""",
)
def valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.rejected_facts(
        inputs.turn_memory(spark, sf_dir), inputs.facts(spark, sf_dir), AS_OF
    )


_NAMES = """
nm AS (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE concat('New ', lang) END AS name,
              CASE WHEN doc_id % 3 = 0 THEN 'feed' WHEN doc_id % 7 = 0 THEN lang END AS entity_type, doc_id AS seq
       FROM documents),
fold AS (SELECT lower(name) AS key, arg_min(name, seq) AS first_name, min(seq) AS first,
                arg_max(entity_type, seq) FILTER (WHERE entity_type IS NOT NULL) AS last_kind,
                min(entity_type) AS low, max(entity_type) AS high FROM nm GROUP BY lower(name))"""


@query(
    "upsert_entities",
    memory("doc") + "," + _NAMES + f"""
SELECT e.id, e.name, CASE WHEN changed THEN coalesce(last_kind, e.entity_type) ELSE e.entity_type END AS entity_type,
       {ts('CASE WHEN NOT changed THEN e.deleted_at END')} AS deleted_at,
       {ts(f'CASE WHEN changed THEN {NOW} ELSE e.updated_at END')} AS updated_at
FROM (SELECT ent.*, f.last_kind, f.key IS NOT NULL AND (ent.deleted_at IS NOT NULL
        OR coalesce(f.low <> ent.entity_type OR f.high <> ent.entity_type, false)) AS changed
      FROM ent LEFT JOIN fold f ON f.key = lower(ent.name)) e
UNION ALL
SELECT (SELECT max(id) FROM ent) + row_number() OVER (ORDER BY first), first_name, last_kind, NULL, {ts(NOW)}
FROM fold WHERE key NOT IN (SELECT lower(name) FROM ent)""",
)
def upsert_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources under other spellings (two of them deleted) and new names, with types."""
    d = F.col("doc_id")
    names = inputs.table(spark, sf_dir, "documents").select(
        F.when(d % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit("New "), "lang")).alias("name"),
        F.when(d % 3 == 0, "feed").when(d % 7 == 0, F.col("lang")).alias("entity_type"),
        d.alias("seq"),
    )
    after, _ = writes.upsert_entities(inputs.entities(spark, sf_dir), names, ["seq"], AS_OF)
    return after.drop("created_at")


@query(
    "remember_batch",
    memory("doc", "m_facts") + _BATCH + "SELECT batch_id, seq, entity_id, obs_id, inserted FROM done",
)
def remember_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.remember_batch(
        inputs.memory(spark, sf_dir), inputs.facts(spark, sf_dir), AS_OF
    ).result


_WRITTEN = (
    "id", "entity_id", "content", "source", "confidence", "event_id", "entity_type", "created_at",
)


@query("add_observations", memory("doc", "m_facts") + _BATCH + _ROWS)
def add_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows a batch adds, with the entity type of that time."""
    write = writes.remember_batch(
        inputs.memory(spark, sf_dir), inputs.facts(spark, sf_dir), AS_OF
    )
    return write.appended["observations"].select(*_WRITTEN)


@query(
    "remember",
    oracle_search.hints(
        _FACT_OWNERS.replace("m_roles", "ent") + """
WHERE f.confidence <= 1 AND trim(f.observation) <> '' AND (f.event_id IS NULL OR f.event_id IN (SELECT id FROM lev))"""
    )
    + _BATCH.replace(
        f"batch_id NOT IN ({_BAD})",
        "confidence <= 1 AND trim(observation) <> '' AND (event_id IS NULL OR event_id IN (SELECT id FROM lev))",
    )
    + """
SELECT seq, entity_id, done.obs_id, inserted, (SELECT count(*) FROM rk WHERE rk.query_id = done.seq AND rank <= 3 AND score >= 0.6) AS hints
FROM done""",
)
def remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn remembered on its own, against the turns as they are."""
    write, hints = writes.remember(
        inputs.turn_memory(spark, sf_dir), inputs.facts(spark, sf_dir), AS_OF, HL
    )
    counts = hints.groupBy("seq").agg(F.count(F.lit(1)).alias("hints"))
    return write.result.join(counts, "seq", "left").select(
        "seq", "entity_id", "obs_id", "inserted", F.coalesce("hints", F.lit(0)).alias("hints")
    )


_TALKS = """
talk AS (SELECT conv_id, concat('talk ', conv_id) AS label FROM (SELECT DISTINCT conv_id FROM conversations) c
         WHERE conv_id % 4 IN (0, 1) AND conv_id % 9 <> 8
           AND conv_id NOT IN (SELECT batch_id FROM m_facts WHERE confidence > 1 OR trim(observation) = ''))"""


@query(
    "remember_event",
    memory("turn", "m_facts") + "," + _TALKS + """
SELECT conv_id AS event_no, (SELECT max(id) FROM ev) + row_number() OVER (ORDER BY conv_id) AS event_id, label,
       (SELECT count(*) FROM m_facts f WHERE f.batch_id = conv_id) AS observations_attached FROM talk""",
)
def remember_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new event per conversation; some have a blank label, a bad end, or have ended."""
    c = F.col("conv_id")
    events = inputs.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        c.alias("event_no"),
        F.when(c % 9 == 8, "  ").otherwise(F.concat(F.lit("talk "), c.cast("string"))).alias("label"),
        F.lit("2024-02-01").alias("event_date"), F.lit("talk").alias("event_type"),
        F.lit(None).cast("string").alias("context"),
        F.when(c % 4 == 1, "2024-03-01T00:00:00Z").when(c % 4 == 2, "soon")
        .when(c % 4 == 3, "2024-01-01 00:00:00").alias("expires_at"),
    )
    facts = inputs.facts(spark, sf_dir).withColumnRenamed("batch_id", "event_no")
    return writes.remember_event(inputs.turn_memory(spark, sf_dir), events, facts, AS_OF).result


_EDGES = """
edge AS (
  SELECT c_custkey AS seq, c_name AS "from", CASE WHEN c_custkey % 11 = 0 THEN lower(c_name) WHEN c_custkey % 5 = 0 THEN 'Planet Earth' ELSE lower(n_name) END AS "to",
         CASE WHEN c_custkey % 3 = 0 THEN 'located_in' ELSE 'buys_in' END AS relation_type
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL
  SELECT c_custkey + 100000000, n_name, 'Planet Earth', 'part_of' FROM customer JOIN nation ON n_nationkey = c_nationkey),
ok AS (SELECT * FROM edge WHERE lower("from") <> lower("to")),
nid AS (
  SELECT lower(name) AS key, id FROM ent
  UNION ALL SELECT 'planet earth', (SELECT max(id) + 1 FROM ent) WHERE EXISTS (SELECT 1 FROM ok WHERE "to" = 'Planet Earth')),
res AS (SELECT ok.seq, a.id AS f, b.id AS t, relation_type FROM ok JOIN nid a ON a.key = lower("from") JOIN nid b ON b.key = lower("to")),
new AS (SELECT f, t, relation_type, min(seq) AS seq FROM res
        WHERE NOT EXISTS (SELECT 1 FROM m_relations r WHERE r.from_entity_id = f AND r.to_entity_id = t AND r.relation_type = res.relation_type)
        GROUP BY f, t, relation_type)"""


@query(
    "relate",
    memory("graph", "m_relations") + "," + _EDGES + """
SELECT 'asked' AS part, res.seq AS id, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t, new.seq IS NOT NULL AS created
FROM res LEFT JOIN new ON new.seq = res.seq
UNION ALL SELECT 'edge', (SELECT max(id) FROM m_relations) + row_number() OVER (ORDER BY seq), f, t, true FROM new""",
)
def relate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations related to nations and a new node; known, equal and repeated edges occur."""
    c = F.col("c_custkey")
    pairs = inputs.table(spark, sf_dir, "customer").join(
        inputs.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    none = F.lit(None).cast("string")
    edges = pairs.select(
        c.alias("seq"), F.col("c_name").alias("from"),
        F.when(c % 11 == 0, F.lower("c_name")).when(c % 5 == 0, "Planet Earth")
        .otherwise(F.lower("n_name")).alias("to"),
        F.when(c % 3 == 0, "located_in").otherwise("buys_in").alias("relation_type"),
        none.alias("context"),
    ).unionByName(
        pairs.select(
            (c + 100000000).alias("seq"), F.col("n_name").alias("from"),
            F.lit("Planet Earth").alias("to"), F.lit("part_of").alias("relation_type"),
            none.alias("context"),
        )
    )
    write = writes.relate(inputs.graph_memory(spark, sf_dir), edges, AS_OF)
    nothing = F.lit(None).cast("long")
    return write.result.select(
        F.lit("asked").alias("part"), F.col("seq").alias("id"), nothing.alias("f"), nothing.alias("t"),
        "created",
    ).unionByName(
        write.appended["relations"].select(
            F.lit("edge").alias("part"), "id", F.col("from_entity_id").alias("f"),
            F.col("to_entity_id").alias("t"), F.lit(True).alias("created"),
        )
    )


@query(
    "forget_observations",
    memory("doc") + f""",
asked AS (SELECT doc_id * 2 AS id FROM documents),
hit AS (SELECT o.id, e.deleted_at IS NULL AS live FROM obs o JOIN ent e ON e.id = o.entity_id
        WHERE o.deleted_at IS NULL AND o.id IN (SELECT id FROM asked))
SELECT 'asked' AS part, a.id, coalesce(hit.live, false) AS deleted FROM asked a LEFT JOIN hit ON hit.id = a.id
UNION ALL SELECT 'row', o.id, o.deleted_at IS NOT NULL OR o.id IN (SELECT id FROM hit) FROM obs o
UNION ALL SELECT 'vector', vec_id + 1, false FROM embeddings WHERE vec_id % 2 = 1 AND vec_id + 1 NOT IN (SELECT id FROM asked)""",
)
def forget_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfade.plans.similar import _cache

    mem = inputs.memory(spark, sf_dir).with_tables(embeddings=_cache(spark, sf_dir))
    ids = inputs.table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("id"))
    write = writes.forget_observations(mem, ids, AS_OF)
    after = write.memory
    return (
        write.result.select(F.lit("asked").alias("part"), "id", "deleted")
        .unionByName(after.observations.select(
            F.lit("row").alias("part"), "id", F.col("deleted_at").isNotNull().alias("deleted")))
        .unionByName(after.embeddings.select(
            F.lit("vector").alias("part"), F.col("observation_id").alias("id"),
            F.lit(False).alias("deleted")))
    )


@query(
    "forget_entities",
    memory("graph", "m_relations") + f"""
SELECT 'asked' AS part, c_custkey AS id, true AS deleted FROM customer
UNION ALL SELECT 'asked', n_nationkey, true FROM nation
UNION ALL SELECT 'entity', id, entity_type IN ('customer', 'nation') FROM ent
UNION ALL SELECT 'edge', r.id, false FROM m_relations r
  WHERE r.from_entity_id NOT IN (SELECT id FROM ent WHERE entity_type IN ('customer', 'nation'))
    AND r.to_entity_id NOT IN (SELECT id FROM ent WHERE entity_type IN ('customer', 'nation'))
UNION ALL SELECT 'row', o.id, false FROM obs o""",
)
def forget_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers and nations by lower-case name; their edges go with them."""
    customers = inputs.table(spark, sf_dir, "customer").select(
        F.lower("c_name").alias("name"), F.col("c_custkey").alias("asked_id")
    )
    nations = inputs.table(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("asked_id")
    )
    asked = customers.unionByName(nations)
    write = writes.forget_entities(inputs.graph_memory(spark, sf_dir), asked, AS_OF)
    after = write.memory
    part = lambda df, name, flag: df.select(
        F.lit(name).alias("part"), "id", flag.alias("deleted")
    )
    gone = F.col("deleted_at").isNotNull()
    return (
        asked.join(write.result, "name").select(
            F.lit("asked").alias("part"), F.col("asked_id").alias("id"), "deleted")
        .unionByName(part(after.entities, "entity", gone))
        .unionByName(part(after.relations, "edge", F.lit(False)))
        .unionByName(part(after.observations, "row", gone))
    )


@query("ingest_stream", memory("doc", "m_facts") + _BATCH + _ROWS)
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns arriving as a stream; the stream is started twice, the second run adds nothing."""
    root, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "stream")
    mem = inputs.memory(spark, sf_dir)
    store.publish(spark, root, "global", mem)
    batch = inputs.table(spark, sf_dir, "conversations")
    arriving = inputs.arriving(spark, sf_dir, "conversations", batch.schema)
    for _ in range(2):
        ingest_stream(inputs.facts_of(arriving), root, checkpoint, AS_OF).awaitTermination()
    before = mem.observations.select("id")
    after = store.load_memory(spark, root, "global").observations
    return after.join(before, "id", "left_anti").select(*_WRITTEN)
