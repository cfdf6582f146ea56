"""Ranked search and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.model import Memory
from factfade.operators import hints, search, textindex, writes
from factfade.operators.postings import TextIndex
from factfade.plans import inputs, oracle_search
from factfade.plans.inputs import AS_OF
from factfade.plans.oracle_views import NOW, decayed, memory, tokens
from factfade.plans.registry import ORACLES, num, query, ts
from factfade.session import scratch_path

HL = 12

_POSTINGS = "UNION ALL ".join(
    f"""
SELECT id AS obs_id, '{field}' AS field, CAST(place - 1 AS BIGINT) AS pos, token FROM (
  SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM (
    SELECT o.id, {tokens(column)} AS t FROM obs o JOIN ent e ON e.id = o.entity_id
    WHERE o.deleted_at IS NULL) a) b
"""
    for field, column in (
        ("entity_name", "e.name"), ("content", "o.content"), ("entity_type", "o.entity_type"),
    )
)


@query("postings", memory("doc") + _POSTINGS)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.postings(inputs.memory(spark, sf_dir), AS_OF)


def _prepared(spark: SparkSession, sf_dir: str):
    mem = inputs.memory(spark, sf_dir)
    return search.prepare_queries(inputs.queries(spark, sf_dir)), mem


def _channel(name: str) -> str:
    return oracle_search.search() + f"""
SELECT query_id, step, channel, obs_id, pos AS position FROM hits WHERE channel = '{name}'"""


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "step", "channel", "obs_id", "position")


@query("fts_any_term", _channel("fts"))
def fts_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, mem = _prepared(spark, sf_dir)
    return _hit_columns(
        search.fts_any_term(prepared, search.search_weights(prepared, mem, AS_OF))
    )


@query("fts_phrase", _channel("fts_phrase"))
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, mem = _prepared(spark, sf_dir)
    return _hit_columns(search.fts_phrase(prepared, search.search_weights(prepared, mem, AS_OF)))


def _simple(name: str) -> None:
    @query(name, _channel(name))
    def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared, mem = _prepared(spark, sf_dir)
        return _hit_columns(getattr(search, name)(prepared, mem, AS_OF))


for _name in ("entity_exact", "entity_like", "content_like", "type_like", "event_label"):
    _simple(_name)


@query(
    "channel_position",
    oracle_search.search() + """
SELECT query_id, channel, count(*) AS n, CAST(max(pos) AS BIGINT) AS last_position, min(obs_id) AS lowest_id
FROM hits GROUP BY query_id, channel""",
)
def channel_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel's hits per query and the last position given."""
    prepared, mem = _prepared(spark, sf_dir)
    return search.channel_hits(prepared, mem, AS_OF).groupBy("query_id", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("last_position"),
        F.min("obs_id").alias("lowest_id"),
    )


@query(
    "candidate_union",
    oracle_search.search() + f"""
SELECT query_id, obs_id, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels,
       {num('max(' + oracle_search._WEIGHT + ')')} AS best_weight, min(fts_pos) AS fts_pos
FROM hits GROUP BY query_id, obs_id""",
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, mem = _prepared(spark, sf_dir)
    merged = search.merge_hits(search.channel_hits(prepared, mem, AS_OF))
    return merged.withColumn("channels", F.array_join("channels", ","))


@query(
    "candidate_cap",
    oracle_search.recall() + f"""
SELECT query_id, obs_id, channels, {num('best_weight')} AS best_weight, fts_pos FROM cand""",
)
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, mem = _prepared(spark, sf_dir)
    candidates = search.collect_candidates(prepared, mem, AS_OF)
    return candidates.withColumn("channels", F.array_join("channels", ","))


_RANKED = f"""
SELECT query_id, rank, obs_id, entity_id, entity_name, entity_type, content, source, access_count,
       {ts('created_at')} AS created_at, event_id, channels, {num('eff')} AS confidence,
       {num('score')} AS composite_score FROM ranked"""


@query("recall", oracle_search.recall() + _RANKED)
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir)
    ranked = search.recall(inputs.queries(spark, sf_dir), mem, AS_OF, HL)
    return ranked.select(
        "query_id", "rank", "obs_id", "entity_id", "entity_name", "entity_type", "content", "source",
        "access_count", "created_at", "event_id", F.array_join("channels", ",").alias("channels"),
        "confidence", "composite_score",
    )


@query(
    "top_k_per_query",
    memory("doc") + f"""
SELECT * FROM (
  SELECT entity_id AS query_id, id AS obs_id, {num(decayed())} AS confidence,
         row_number() OVER (PARTITION BY entity_id ORDER BY 0.7 * 0.9 + 0.3 * {decayed()} DESC, {decayed()} DESC, id) AS rank
  FROM liv) a WHERE rank <= 20""",
)
def top_k_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visible row as a candidate of its entity, the best 20 of each."""
    mem = inputs.memory(spark, sf_dir)
    everyone = mem.observations.select(
        F.col("entity_id").alias("query_id"), F.col("id").alias("obs_id"),
        F.array(F.lit("entity_exact")).alias("channels"), F.lit(0.9).alias("best_weight"),
        F.lit(None).cast("int").alias("fts_pos"),
    )
    keep = mem.entities.select(F.col("id").alias("query_id"), F.lit(20).alias("keep"))
    ranked = search.score_candidates(search.hydrate(everyone, mem, AS_OF), keep, AS_OF, HL)
    return ranked.select("query_id", "obs_id", "confidence", "rank")


def _searched(spark: SparkSession, sf_dir: str):
    queries = inputs.queries(spark, sf_dir)
    prepared, mem = _prepared(spark, sf_dir)
    candidates = search.collect_candidates(prepared, mem, AS_OF)
    return queries, candidates, search.recall_from(candidates, prepared, mem, AS_OF, HL)


@query(
    "channel_counts",
    oracle_search.recall() + """
SELECT query_id, channel, count(DISTINCT obs_id) AS candidates FROM kept GROUP BY query_id, channel""",
)
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, candidates, _ = _searched(spark, sf_dir)
    return search.channel_counts(candidates)


@query(
    "score_stats",
    oracle_search.recall() + f"""
SELECT m.query_id, {oracle_search.trimmed('m.text')} AS query, CAST(m.max_results AS BIGINT) AS limit_requested,
  (SELECT count(*) FROM cand c WHERE c.query_id = m.query_id) AS candidates_total,
  (SELECT count(*) FROM ranked r WHERE r.query_id = m.query_id) AS results_returned,
  coalesce((SELECT {num('min(score)')} FROM ranked r WHERE r.query_id = m.query_id), 0) AS score_min,
  coalesce((SELECT {num('max(score)')} FROM ranked r WHERE r.query_id = m.query_id), 0) AS score_max,
  coalesce((SELECT {num('quantile_cont(score, 0.5)')} FROM ranked r WHERE r.query_id = m.query_id), 0) AS score_median
FROM m_queries m""",
)
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.score_stats(*_searched(spark, sf_dir))


@query(
    "search_metrics",
    oracle_search.recall() + f"""
SELECT m.query_id, mode, CASE WHEN mode = 'open' OR t = '' THEN t ELSE concat('sha256:', sha256(t)) END AS query,
  0 AS fts_query_errors, mode = 'strict' AS compact,
  (SELECT count(*) FROM cand c WHERE c.query_id = m.query_id) AS candidates_total,
  coalesce((SELECT string_agg(concat(channel, '=', n), ',' ORDER BY channel) FROM (
     SELECT query_id, channel, count(DISTINCT obs_id) AS n FROM kept GROUP BY query_id, channel) k
     WHERE k.query_id = m.query_id), '') AS channels
FROM (SELECT m.*, {oracle_search.trimmed('m.text')} AS t FROM m_queries m) m, (VALUES ('open'), ('strict')) v(mode)""",
)
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows in both modes: open, and strict with compact results."""
    searched = _searched(spark, sf_dir)
    metrics = search.search_metrics(*searched).withColumn("mode", F.lit("open")).unionByName(
        search.search_metrics(*searched, compact=True, strict=True).withColumn("mode", F.lit("strict"))
    )
    shown = F.array_join(
        F.transform(
            F.map_entries("channels"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )
    return metrics.select(
        "query_id", "mode", "query", "fts_query_errors", "compact", "candidates_total",
        shown.alias("channels"),
    )


@query(
    "recall_grouped",
    oracle_search.recall() + """,
g AS (SELECT query_id, entity_name, min(rank) AS first_rank, arg_min(entity_type, rank) AS entity_type,
        string_agg(concat(obs_id, ':', length(CASE WHEN length(content) > 120 THEN concat(substr(content, 1, 119), '…') ELSE content END),
                          ':', CASE WHEN length(content) > 120 THEN 'cut' ELSE 'whole' END), ',' ORDER BY rank) AS observations,
        count(*) AS n FROM ranked GROUP BY query_id, entity_name)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS group_no, entity_name, entity_type,
       observations, CAST(sum(n) OVER (PARTITION BY query_id) AS BIGINT) AS total_facts FROM g""",
)
def recall_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir)
    ranked = search.recall(inputs.queries(spark, sf_dir), mem, AS_OF, HL)
    shown = F.array_join(
        F.transform(
            "observations",
            lambda o: F.concat_ws(
                ":", o["id"].cast("string"), F.char_length(o["content"]).cast("string"),
                F.when(o["truncated"], "cut").otherwise("whole"),
            ),
        ),
        ",",
    )
    return search.recall_grouped(ranked, compact=True).withColumn("observations", shown)


@query(
    "touch",
    memory("doc") + f""",
ret AS (SELECT doc_id + 1 AS id FROM documents UNION ALL SELECT doc_id // 2 + 1 FROM documents),
times AS (SELECT r.id, count(*) AS n FROM ret r JOIN liv ON liv.id = r.id GROUP BY r.id)
SELECT o.id, o.access_count + coalesce(t.n, 0) AS access_count,
       {ts(f'CASE WHEN t.n IS NOT NULL THEN {NOW} END')} AS last_accessed
FROM obs o LEFT JOIN times t ON t.id = o.id""",
)
def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir)
    d = inputs.table(spark, sf_dir, "documents")
    returned = d.select((F.col("doc_id") + 1).alias("id")).unionAll(
        d.select((F.floor(F.col("doc_id") / 2) + 1).alias("id"))
    )
    return search.touch(mem, returned, AS_OF).select("id", "access_count", "last_accessed")


@query(
    "text_match_ids",
    oracle_search.text_only() + """
SELECT query_id, obs_id, round(r, 6) AS text_rank, row_number() OVER (PARTITION BY query_id ORDER BY r, obs_id) AS pos
FROM (SELECT query_id, wgt.obs_id, round(-sum(weight * times), 9) AS r
      FROM tp JOIN wgt ON wgt.phrase = tp.phrase GROUP BY query_id, wgt.obs_id) x""",
)
def text_match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_match_ids(
        inputs.queries(spark, sf_dir), inputs.memory(spark, sf_dir), AS_OF
    )


_FACT_OWNERS = """
SELECT f.seq AS query_id, e.id AS entity_id, f.observation AS content
FROM m_facts f JOIN m_roles e ON e.name = lower(f.entity)"""


@query(
    "conflict_hints",
    oracle_search.hints(_FACT_OWNERS.replace("m_roles", "ent")) + f"""
SELECT query_id AS seq, rank, obs_id, {num('score')} AS similarity,
       CASE WHEN length(content) > 120 THEN concat(substr(content, 1, 119), '…') ELSE content END AS snippet
FROM rk WHERE rank <= 3 AND score >= 0.6""",
)
def conflict_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.turn_memory(spark, sf_dir)
    facts = inputs.facts(spark, sf_dir).join(
        mem.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("role")),
        F.lower("entity") == F.col("role"),
    )
    return hints.conflict_hints(
        facts.select("seq", "entity_id", F.col("observation").alias("content")), mem, AS_OF, HL
    )


# The same searches from an index on shared storage.


def _stored(mem: Memory) -> TextIndex:
    return TextIndex.build(mem, scratch_path(mem.observations.sparkSession, "text-index"))


@query("fts_any_term_stored", ORACLES["fts_any_term"])
def fts_any_term_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, mem = _prepared(spark, sf_dir)
    return _hit_columns(search.fts_any_term_indexed(prepared, _stored(mem), mem, AS_OF))


@query("fts_phrase_stored", ORACLES["fts_phrase"])
def fts_phrase_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, mem = _prepared(spark, sf_dir)
    weights = search.search_weights(prepared, mem, AS_OF, _stored(mem))
    return _hit_columns(search.fts_phrase(prepared, weights))


@query("text_match_ids_stored", ORACLES["text_match_ids"])
def text_match_ids_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir)
    return search.text_match_ids(inputs.queries(spark, sf_dir), mem, AS_OF, _stored(mem))


@query(
    "index_after_writes",
    memory("doc") + f"""
SELECT token, count(DISTINCT obs_id) AS n_rows FROM ({_POSTINGS}) p WHERE obs_id % 10 <> 0 GROUP BY token""",
)
def index_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold each token, after rows came in two batches and a tenth was forgotten."""
    mem = inputs.memory(spark, sf_dir)
    index = TextIndex(spark, scratch_path(spark, "text-index"))
    late = F.col("id") % 3 == 0
    index.add(mem.observations.filter(~late), mem.entities, batch=0)
    index.add(mem.observations.filter(late), mem.entities, batch=1)
    ids = mem.observations.filter(F.col("id") % 10 == 0).select("id")
    index.follow(mem, writes.forget_observations(mem, ids, AS_OF), batch=2)
    return index.all_counts().select("token", F.col("n").alias("n_rows"))
