"""Analytics over the usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.functions.privacy import hash_identifier as hash_column
from factfade.operators import usage
from factfade.plans import inputs
from factfade.plans.oracle_views import only
from factfade.plans.registry import num, query, ts
from factfade.session import scratch_path
from factfade.streaming.log import usage_stream as stream_counts

_CALLS, _METRICS = only("m_tool_calls"), only("m_search_metrics")
_BOTH = only("m_tool_calls", "m_search_metrics")


@query(
    "hash_identifier",
    "SELECT doc_id, concat('sha256:', sha256(source)) AS hashed, source AS open FROM documents",
)
def hash_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("source")
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", hash_column(source).alias("hashed"), hash_column(source, strict=False).alias("open")
    )


def _summary(entity: str) -> str:
    return f"""concat('{{"confidence":0.5,"content":"<redacted null>","context":"<redacted array>","entity":"', {entity},
  '","facts":"<2 facts>","label":"<redacted object>","observation":"<', length(text), ' chars>","query":"<redacted number>","turn":', turn, '}}')"""


@query(
    "sanitize_args",
    f"""SELECT conv_id, turn, {_summary('role')} AS open, {_summary("concat('sha256:', sha256(role))")} AS strict
FROM conversations""",
)
def sanitize_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as call arguments with every kind of field."""
    args = F.to_json(
        F.struct(
            F.col("role").alias("entity"), F.col("text").alias("observation"), "turn",
            F.lit(0.5).alias("confidence"), F.array(F.lit(1), F.lit(2)).alias("facts"),
            F.col("turn").alias("query"),
        )
    )
    head = F.lit('{"content":null,"context":["x"],"label":{"a":1},')
    calls = inputs.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(head, F.regexp_replace(args, r"^\{", "")).alias("args")
    )
    both = usage.sanitize_args(
        usage.sanitize_args(calls, "args").withColumnRenamed("args_summary", "open"), "args", True
    )
    return both.select("conv_id", "turn", "open", F.col("args_summary").alias("strict"))


@query(
    "summarize_results",
    _METRICS + """
SELECT tool_call_id, concat('{"compact":false,"entity_groups":', results_returned, ',"total_facts":', results_returned, '}') AS result_summary
FROM m_search_metrics""",
)
def summarize_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("results_returned")
    results = inputs.search_metrics(spark, sf_dir).select(
        "tool_call_id",
        F.concat(
            F.lit('{"results":['), F.array_join(F.array_repeat(F.lit('{"x":1}'), n.cast("int")), ","),
            F.lit('],"total_facts":'), n.cast("string"), F.lit(',"compact":false,"query":"'), "query",
            F.lit('"}'),
        ).alias("result"),
    )
    return usage.summarize_results(results, "result").drop("result")


@query(
    "usage_by_client",
    _CALLS + "SELECT client_name, tool, count(*) AS calls, round(avg(CAST(duration_ms AS DECIMAL(18,6))), 1) AS avg_ms FROM m_tool_calls GROUP BY client_name, tool",
)
def usage_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_by_client(inputs.tool_calls(spark, sf_dir))


@query(
    "ranking_quality",
    _METRICS + """
SELECT tool_call_id, query, candidates_total, results_returned, round(score_min, 3) AS score_min,
       round(score_max, 3) AS score_max, fts_query_errors,
       CASE WHEN fts_phrase_hits > 0 THEN concat('fts=', fts_hits, ',fts_phrase=', fts_phrase_hits) ELSE concat('fts=', fts_hits) END AS channels
FROM m_search_metrics ORDER BY candidates_total DESC, tool_call_id LIMIT 20""",
)
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(
        F.transform(
            F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        ),
        ",",
    )
    return usage.ranking_quality(inputs.search_metrics(spark, sf_dir)).withColumn("channels", shown)


@query(
    "degraded_searches",
    _BOTH + f"""
SELECT m.tool_call_id, {ts('c.ts')} AS ts, c.tool, m.query, m.fts_query_errors AS errors
FROM m_search_metrics m JOIN m_tool_calls c ON c.id = m.tool_call_id WHERE m.fts_query_errors > 0
UNION ALL SELECT id, {ts('ts')}, tool, NULL, conflict_fts_query_errors FROM m_tool_calls WHERE conflict_fts_query_errors > 0""",
)
def degraded_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.degraded_searches(
        inputs.tool_calls(spark, sf_dir), inputs.search_metrics(spark, sf_dir)
    )


@query(
    "overfetch",
    _METRICS + """
SELECT tool_call_id, query, candidates_total, results_returned, limit_requested,
       round(results_returned / candidates_total::DOUBLE, 2) AS yield_ratio
FROM m_search_metrics WHERE candidates_total > 0 ORDER BY yield_ratio, tool_call_id LIMIT 20""",
)
def overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.overfetch(inputs.search_metrics(spark, sf_dir))


@query(
    "error_rate",
    _CALLS + """
SELECT tool, count(*) AS total, CAST(sum(is_error) AS BIGINT) AS errors,
       round(100.0::DOUBLE * sum(is_error) / count(*), 1) AS error_pct FROM m_tool_calls GROUP BY tool""",
)
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.error_rate(inputs.tool_calls(spark, sf_dir))


@query(
    "channel_effectiveness",
    _METRICS + """
SELECT 'fts' AS channel, count(*) AS appearances FROM m_search_metrics WHERE fts_hits > 0
UNION ALL SELECT 'fts_phrase', count(*) FROM m_search_metrics WHERE fts_phrase_hits > 0""",
)
def channel_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.channel_effectiveness(inputs.search_metrics(spark, sf_dir))


@query(
    "hint_action_ratio",
    _CALLS + f"""
SELECT db_scope, count(*) AS calls_with_hints, CAST(sum(conflicts_surfaced) AS BIGINT) AS hints_surfaced,
       count(*) FILTER (WHERE acted) AS acted_on, {num('count(*) FILTER (WHERE acted) / count(*)::DOUBLE')} AS ratio
FROM (SELECT h.*, EXISTS (SELECT 1 FROM m_tool_calls f WHERE f.tool = 'forget' AND f.entity_key = h.entity_key
                          AND f.ts > h.ts AND f.ts <= h.ts + INTERVAL 1 DAY) AS acted
      FROM m_tool_calls h WHERE h.tool = 'remember' AND h.conflicts_surfaced > 0) x
GROUP BY db_scope""",
)
def hint_action_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.hint_action_ratio(inputs.tool_calls(spark, sf_dir), 86400)


@query(
    "entity_transitions",
    _CALLS + """
SELECT CASE concat(before, '->', tool) WHEN 'remember->remember' THEN 'silent_overwrite'
         WHEN 'remember->forget' THEN 'forget_correction' ELSE 'post_forget_rewrite' END AS transition, count(*) AS n
FROM (SELECT tool, ts, lag(tool) OVER w AS before, lag(ts) OVER w AS before_ts FROM m_tool_calls
      WHERE tool IN ('remember', 'forget') WINDOW w AS (PARTITION BY entity_key ORDER BY ts, id)) x
WHERE before IS NOT NULL AND ts <= before_ts + INTERVAL 7 DAY AND concat(before, '->', tool) <> 'forget->forget'
GROUP BY 1""",
)
def entity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.entity_transitions(inputs.tool_calls(spark, sf_dir))


@query(
    "usage_stream",
    _CALLS + f"""
SELECT {ts("date_trunc('hour', ts)")} AS bucket_start, client_name, tool, count(*) AS calls,
       round(avg(CAST(duration_ms AS DECIMAL(18,6))), 1) AS avg_ms, CAST(sum(is_error) AS BIGINT) AS errors,
       round(100.0::DOUBLE * sum(is_error) / count(*), 1) AS error_pct
FROM m_tool_calls GROUP BY date_trunc('hour', ts), client_name, tool
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM m_tool_calls)""",
)
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream; buckets the watermark has passed are final."""
    batch = inputs.table(spark, sf_dir, "events")
    arriving = inputs.arriving(spark, sf_dir, "events", batch.schema)
    out, checkpoint = scratch_path(spark, "usage"), scratch_path(spark, "stream")
    counts = stream_counts(inputs.calls_of(arriving))
    (
        counts.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        .start().awaitTermination()
    )
    return spark.read.schema(counts.schema).parquet(out)
