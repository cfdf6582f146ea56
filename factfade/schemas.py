"""Table schemas, default values and schema versions."""

from __future__ import annotations

from pyspark.sql import types as T


# Times are UTC and carry no zone, so that no session setting can shift them.
TABLES: dict[str, str] = {
    "entities": (
        "id long, name string, entity_type string, deleted_at timestamp_ntz, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "observations": (
        "id long, entity_id long, content string, source string, confidence double, "
        "access_count long, last_accessed timestamp_ntz, event_id long, entity_type string, "
        "deleted_at timestamp_ntz, superseded_by long, superseded_at timestamp_ntz, "
        "superseded_reason string, superseded_by_run long, created_at timestamp_ntz"
    ),
    "relations": (
        "id long, from_entity_id long, to_entity_id long, relation_type string, "
        "context string, created_at timestamp_ntz"
    ),
    "events": (
        "id long, label string, event_date string, event_type string, context string, "
        "expires_at timestamp_ntz, created_at timestamp_ntz"
    ),
    "runs": (
        "id long, ts timestamp_ntz, mode string, trigger_source string, scope string, "
        "scanned_entities int, candidates_proposed int, supersessions_applied long, "
        "duration_ms int, notes string"
    ),
    # The source ids of a decision live in a table of their own: one group of
    # copies may hold a large share of all rows, too many for one array.
    "decisions": (
        "id long, run_id long, kind string, entity_id long, target_obs_id long, "
        "content_snapshot string, similarity double, action string, rationale string, "
        "reverted_at timestamp_ntz, reverted_by_run long"
    ),
    "decision_sources": ("decision_id long, source_obs_id long"),
    "embeddings": (
        "observation_id long, provider string, endpoint_key string, model_id string, "
        "dimensions int, embedding array<float>, created_at timestamp_ntz"
    ),
    "tool_calls": (
        "id long, ts timestamp_ntz, tool string, client_name string, client_version string, "
        "client_source string, db_scope string, project_path string, duration_ms double, "
        "args_summary string, result_summary string, is_error int, conflicts_surfaced long, "
        "conflict_fts_query_errors long"
    ),
    "search_metrics": (
        "id long, tool_call_id long, query string, channels map<string,long>, "
        "candidates_total long, results_returned long, limit_requested long, "
        "score_min double, score_max double, score_median double, fts_query_errors long, "
        "compact int"
    ),
}

def table_schema(table: str) -> T.StructType:
    """Schema of one table (needs a running session)."""
    return T.StructType.fromDDL(TABLES[table])


MEMORY_TABLES = (
    "entities", "observations", "relations", "events",
    "runs", "decisions", "decision_sources", "embeddings",
)

# Defaults of columns that an older table may lack.
COLUMN_DEFAULTS = {
    ("observations", "source"): "user",
    ("observations", "confidence"): 1.0,
    ("observations", "access_count"): 0,
    ("runs", "scanned_entities"): 0,
    ("runs", "candidates_proposed"): 0,
    ("runs", "supersessions_applied"): 0,
    ("runs", "duration_ms"): 0,
    ("tool_calls", "db_scope"): "global",
    ("tool_calls", "is_error"): 0,
    ("tool_calls", "conflicts_surfaced"): 0,
    ("tool_calls", "conflict_fts_query_errors"): 0,
    ("search_metrics", "fts_query_errors"): 0,
    ("search_metrics", "compact"): 0,
}

# Columns that take the time of the upgrade when they are empty.
BACKFILLED = {("entities", "created_at"), ("entities", "updated_at")}

# Highest schema version of a store and of a usage log.
MEMORY_VERSIONS = 16
LOG_VERSIONS = 3
