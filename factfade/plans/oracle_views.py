"""The given tables as a memory store, for DuckDB.

``memory(kind)`` gives common table expressions ``ent``, ``obs`` and ``ev`` and,
built on them, ``lev`` (live events), ``act`` (active observations) and ``liv``
(active observations of entities that are not deleted).
"""

from __future__ import annotations

from factfade.functions.text import ACCENTED, MARKS, QUOTES, UNACCENTED, WHITE
from factfade.plans.inputs import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"

VIEWS = {
    "m_entities": """
SELECT id, name, CASE WHEN id % 2 = 1 THEN 'feed' ELSE 'corpus' END AS entity_type,
       CASE WHEN id % 10 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS deleted_at,
       TIMESTAMP '2023-01-01 00:00:00' AS created_at,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(id AS INT) AS updated_at
FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS id, source AS name FROM documents) d""",
    "m_events": """
SELECT conv_id + 1 AS id, concat('conversation ', CAST(conv_id AS VARCHAR)) AS label,
       concat('2024-01-', lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0')) AS event_date,
       CASE WHEN conv_id % 2 = 0 THEN 'chat' ELSE 'review' END AS event_type,
       CAST(NULL AS VARCHAR) AS context,
       CASE WHEN conv_id % 5 = 0 THEN TIMESTAMP '2024-01-31 23:00:00'
            WHEN conv_id % 5 = 1 THEN TIMESTAMP '2024-03-01 00:00:00' END AS expires_at,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id AS INT) AS created_at
FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "m_observations": """
SELECT doc_id + 1 AS id, CAST(substr(source, 4) AS BIGINT) + 1 AS entity_id, text AS content,
       CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'inferred' ELSE 'session' END AS source,
       CAST(doc_id % 11 AS DOUBLE) / 10.0 AS confidence, doc_id % 8 AS access_count,
       CASE WHEN doc_id % 97 = 96 THEN CAST(999999999 AS BIGINT)
            WHEN doc_id % 4 = 0 THEN doc_id % 10 + 1 END AS event_id,
       lang AS entity_type,
       CASE WHEN doc_id % 17 = 16 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at,
       CASE WHEN doc_id % 23 = 22 THEN doc_id END AS superseded_by,
       TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' DAY * CAST(doc_id % 200 AS INT) AS created_at
FROM documents""",
    "m_roles": """
SELECT DISTINCT CAST(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS BIGINT) AS id,
       role AS name, 'role' AS entity_type, CAST(NULL AS TIMESTAMP) AS deleted_at,
       TIMESTAMP '2023-01-01 00:00:00' AS created_at, TIMESTAMP '2023-01-01 00:00:00' AS updated_at
FROM conversations""",
    "m_turns": """
SELECT conv_id * 100 + turn + 1 AS id,
       CAST(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS BIGINT) AS entity_id,
       text AS content, 'user' AS source, CAST(1.0 AS DOUBLE) AS confidence, turn % 4 AS access_count,
       conv_id + 1 AS event_id, 'role' AS entity_type, CAST(NULL AS TIMESTAMP) AS deleted_at,
       CAST(NULL AS BIGINT) AS superseded_by,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id * 10 + turn AS INT) AS created_at
FROM conversations""",
    "m_langs": """
SELECT DISTINCT CAST(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS BIGINT) AS id,
       lang AS name, 'language' AS entity_type, CAST(NULL AS TIMESTAMP) AS deleted_at,
       TIMESTAMP '2023-01-01 00:00:00' AS created_at, TIMESTAMP '2023-01-01 00:00:00' AS updated_at
FROM documents""",
    "m_lang_observations": """
SELECT doc_id + 1 AS id,
       CAST(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS BIGINT) AS entity_id,
       text AS content, source, CAST(1.0 AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS access_count,
       CAST(NULL AS BIGINT) AS event_id, 'language' AS entity_type, CAST(NULL AS TIMESTAMP) AS deleted_at,
       CAST(NULL AS BIGINT) AS superseded_by,
       TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' DAY * CAST(doc_id % 60 AS INT) AS created_at
FROM documents""",
    "m_graph_nodes": """
SELECT CAST(r_regionkey AS BIGINT) + 1 AS id, r_name AS name, 'region' AS entity_type,
       CAST(NULL AS TIMESTAMP) AS deleted_at, TIMESTAMP '2023-01-01 00:00:00' AS created_at,
       TIMESTAMP '2023-01-01 00:00:00' AS updated_at FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, n_name, 'nation', NULL,
       TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-01-01 00:00:00' FROM nation
UNION ALL SELECT s_suppkey + 1000, s_name, 'supplier', NULL,
       TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-01-01 00:00:00' FROM supplier
UNION ALL SELECT c_custkey + 10000000, c_name, 'customer', NULL,
       TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-01-01 00:00:00' FROM customer""",
    "m_relations": """
SELECT CAST(n_nationkey AS BIGINT) + 1 AS id, CAST(n_nationkey AS BIGINT) + 100 AS from_entity_id,
       CAST(n_regionkey AS BIGINT) + 1 AS to_entity_id, 'part_of' AS relation_type FROM nation
UNION ALL SELECT s_suppkey + 1000, s_suppkey + 1000, CAST(s_nationkey AS BIGINT) + 100, 'located_in' FROM supplier
UNION ALL SELECT c_custkey + 10000000, c_custkey + 10000000, CAST(c_nationkey AS BIGINT) + 100, 'located_in' FROM customer""",
    "m_embeddings": """
SELECT vec_id + 1 AS obs_id, CAST(label AS BIGINT) + 1 AS entity_id,
       concat('label ', CAST(label AS VARCHAR)) AS entity_name, embedding, vec_id % 2 = 1 AS cached,
       TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST(vec_id % 500 AS INT) AS created_at
FROM embeddings""",
    "m_tool_calls": """
SELECT event_id + 1 AS id, ts,
       CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'remember' WHEN 'purchase' THEN 'forget'
                       WHEN 'signup' THEN 'remember_event' ELSE 'recall_entity' END AS tool,
       concat('client', CAST(user_id % 5 AS VARCHAR)) AS client_name,
       CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'project' END AS db_scope,
       user_id AS entity_key, value AS duration_ms, props AS args_summary,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
       CASE WHEN event_type = 'click' THEN event_id % 4 ELSE 0 END AS conflicts_surfaced,
       CASE WHEN event_type = 'click' AND event_id % 37 = 0 THEN 1 ELSE 0 END AS conflict_fts_query_errors
FROM events""",
    "m_search_metrics": """
SELECT event_id + 1 AS tool_call_id, concat('q', CAST(user_id AS VARCHAR)) AS query,
       event_id % 90 + 1 AS fts_hits, event_id % 7 AS fts_phrase_hits,
       event_id % 90 + 1 AS candidates_total, least(event_id % 90 + 1, 20) AS results_returned,
       20 AS limit_requested, value / 1000.0 AS score_min, value / 500.0 AS score_max,
       CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS fts_query_errors
FROM events WHERE event_type = 'view'""",
    "m_queries": """
SELECT * FROM (VALUES (1, 'src1', 10), (2, 'the of', 20), (3, 'feed', 5), (4, 'conversation 6', 10),
  (5, '%', 5), (6, '   ', 5), (7, 'the', 0), (8, 'the of an', 66)) AS t(query_id, text, max_results)
UNION ALL SELECT item_id + 100, text, 20 FROM benchmark""",
    "m_facts": """
SELECT conv_id AS batch_id, conv_id * 100 + turn AS seq,
       CASE WHEN turn % 2 = 0 THEN role ELSE upper(role) END AS entity,
       CASE WHEN turn % 3 = 0 THEN 'speaker' END AS entity_type, text AS observation,
       CASE WHEN (conv_id * 100 + turn) % 301 = 5 THEN 1.5 ELSE 0.5 END AS confidence,
       CASE WHEN turn = 0 THEN conv_id + 1 END AS event_id
FROM conversations""",
}

_KINDS = {
    "doc": ("m_entities", "m_observations"),
    "turn": ("m_roles", "m_turns"),
    "lang": ("m_langs", "m_lang_observations"),
    "graph": ("m_graph_nodes", "m_turns"),
}

_STATE = f"""
lev AS (SELECT * FROM ev WHERE expires_at IS NULL OR expires_at > {NOW}),
act AS (SELECT o.* FROM obs o WHERE o.deleted_at IS NULL AND o.superseded_by IS NULL
        AND (o.event_id IS NULL OR EXISTS (SELECT 1 FROM lev WHERE lev.id = o.event_id))),
liv AS (SELECT a.* FROM act a JOIN ent e ON e.id = a.entity_id WHERE e.deleted_at IS NULL)"""


def _cte(name: str, body: str) -> str:
    return f"{name} AS ({body.strip()})"


def memory(kind: str = "doc", *views: str) -> str:
    """``WITH ...`` for one store and, after it, further views by name."""
    entities, observations = _KINDS[kind]
    parts = [
        _cte("ent", VIEWS[entities]), _cte("obs", VIEWS[observations]), _cte("ev", VIEWS["m_events"]),
        _STATE.strip(),
    ] + [_cte(v, VIEWS[v]) for v in views]
    return "WITH " + ",\n".join(parts)


def only(*views: str) -> str:
    return "WITH " + ",\n".join(_cte(v, VIEWS[v]) for v in views)


def decayed(prefix: str = "", confidence: str = "confidence", half_life: str = "12.0") -> str:
    """Confidence after decay, as one expression."""
    age = f"(epoch_us({NOW}) - epoch_us({prefix}created_at)) / 604800000000.0"
    stability = f"({half_life} * (1 + log2({prefix}access_count + 1)))"
    c = f"{prefix}{confidence}"
    return f"least({c}, {c} * pow(0.5, ({age}) / {stability}))"


def folded(c: str) -> str:
    return f"translate(lower({c}), '{ACCENTED}{MARKS}', '{UNACCENTED}')"


def tokens(c: str) -> str:
    return rf"regexp_extract_all({folded(c)}, '[\p{{L}}\p{{N}}]+')"


def ascii_lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}|{WHITE}$', '', 'g')"


def terms(c: str) -> str:
    return f"list_filter(string_split_regex({trimmed(c)}, '{WHITE}'), lambda t: t <> '')"


def clean(c: str) -> str:
    return (
        f"list_filter(list_transform({terms(c)}, lambda t: translate(t, '{QUOTES}', '')), "
        "lambda t: t <> '')"
    )
