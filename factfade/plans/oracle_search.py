"""DuckDB texts of the ranked search and of the hints."""

from __future__ import annotations

from factfade.plans.oracle_views import ascii_lower, clean, decayed, memory, terms, tokens, trimmed

# Weights of phrases in rows; needs a view ``phr`` (phrase).
TEXT = f"""
docs AS (
  SELECT o.id AS obs_id, list_concat(list_concat({tokens('e.name')}, ['|']),
         list_concat({tokens('o.content')}, list_concat(['|'], coalesce({tokens('o.entity_type')}, [])))) AS words
  FROM obs o JOIN ent e ON e.id = o.entity_id WHERE o.deleted_at IS NULL),
tok AS (SELECT obs_id, unnest(words) AS token, generate_subscripts(words, 1) AS place FROM docs),
tot AS (SELECT count(*) AS n_rows, sum(len(words) - 2) / count(*) AS mean_tokens FROM docs),
pw AS (SELECT phrase, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS n FROM phr),
occ AS (
  SELECT pw.phrase, tok.obs_id FROM tok JOIN pw ON pw.n = 1 AND tok.token = pw.phrase
  UNION ALL
  SELECT pw.phrase, tok.obs_id FROM tok JOIN pw ON pw.n > 1 AND tok.token = pw.w[1]
  JOIN docs ON docs.obs_id = tok.obs_id WHERE docs.words[tok.place:tok.place + pw.n - 1] = pw.w),
hit AS (SELECT phrase, obs_id, count(*) AS tf FROM occ GROUP BY phrase, obs_id),
idf AS (SELECT phrase, greatest(1e-6, ln((n_rows - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))) AS idf
        FROM hit, tot GROUP BY phrase, n_rows),
wgt AS (
  SELECT hit.phrase, hit.obs_id, liv.entity_id,
         idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(words) - 2) / mean_tokens)) AS weight
  FROM hit JOIN idf ON idf.phrase = hit.phrase JOIN docs ON docs.obs_id = hit.obs_id
  JOIN liv ON liv.id = hit.obs_id, tot)"""

_PREPARED = f"""
q AS (
  SELECT query_id, {trimmed('text')} AS text, least(200, max_results) AS keep, 3 * least(200, max_results) AS collect,
         greatest(200, 3 * least(200, max_results)) AS cap, {terms('text')} AS terms, {clean('text')} AS clean
  FROM m_queries WHERE max_results > 0 AND {trimmed('text')} <> ''),
tp AS (
  SELECT query_id, collect, phrase, count(*) AS times FROM (
    SELECT query_id, collect, array_to_string({tokens('term')}, ' ') AS phrase
    FROM (SELECT query_id, collect, unnest(clean) AS term FROM q) a) b
  WHERE phrase <> '' GROUP BY query_id, collect, phrase),
wp AS (
  SELECT * FROM (SELECT query_id, collect, array_to_string({tokens("array_to_string(clean, ' ')")}, ' ') AS phrase
                 FROM q WHERE len(terms) > 1) a WHERE phrase <> ''),
phr AS (SELECT phrase FROM tp UNION SELECT phrase FROM wp)"""

_CHANNELS = f"""
any_term AS (
  SELECT query_id, 1 AS step, 'fts' AS channel, obs_id, pos, pos AS fts_pos FROM (
    SELECT query_id, collect, obs_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, obs_id) - 1 AS pos
    FROM (SELECT tp.query_id, tp.collect, wgt.obs_id, sum(weight * times) AS score
          FROM tp JOIN wgt ON wgt.phrase = tp.phrase GROUP BY tp.query_id, tp.collect, wgt.obs_id) a) b
  WHERE pos < collect),
phrase AS (
  SELECT query_id, 0 AS step, 'fts_phrase' AS channel, obs_id, pos, pos AS fts_pos FROM (
    SELECT wp.query_id, wp.collect, wgt.obs_id,
           row_number() OVER (PARTITION BY wp.query_id ORDER BY round(weight, 9) DESC, wgt.obs_id) - 1 AS pos
    FROM wp JOIN wgt ON wgt.phrase = wp.phrase) b WHERE pos < collect),
named AS (SELECT l.id AS obs_id, l.event_id, {ascii_lower('l.content')} AS content, {ascii_lower('e.name')} AS name,
                 {ascii_lower('e.entity_type')} AS kind, {ascii_lower('lev.label')} AS label
          FROM liv l JOIN ent e ON e.id = l.entity_id LEFT JOIN lev ON lev.id = l.event_id),
qt AS (SELECT query_id, collect, len(terms) AS m, {ascii_lower('text')} AS text FROM q),
tt AS (SELECT query_id, collect, m, {ascii_lower('term')} AS term, no FROM (
         SELECT query_id, collect, len(terms) AS m, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS no FROM q) a),
simple AS (
  SELECT query_id, collect, 2 AS step, 'entity_exact' AS channel, obs_id FROM qt JOIN named ON name = text
  UNION ALL SELECT query_id, collect, 3, 'entity_like', obs_id FROM qt JOIN named ON contains(name, text) AND name <> text
  UNION ALL SELECT query_id, collect, 4 + no, 'content_like', obs_id FROM tt JOIN named ON contains(content, term)
  UNION ALL SELECT query_id, collect, 4 + m + no, 'type_like', obs_id FROM tt JOIN named ON contains(kind, term)
  UNION ALL SELECT query_id, collect, 4 + 2 * m, 'event_label', obs_id FROM qt JOIN named ON contains(label, text)),
ids AS (
  SELECT query_id, step, channel, obs_id, pos, CAST(NULL AS BIGINT) AS fts_pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY obs_id) - 1 AS pos FROM simple) a
  WHERE pos < collect),
hits AS (SELECT * FROM phrase UNION ALL SELECT * FROM any_term UNION ALL SELECT * FROM ids)"""

_WEIGHT = """CASE channel WHEN 'fts_phrase' THEN 1.15::DOUBLE WHEN 'fts' THEN 1.0::DOUBLE
  WHEN 'entity_exact' THEN 0.9::DOUBLE WHEN 'entity_like' THEN 0.7::DOUBLE WHEN 'content_like' THEN 0.5::DOUBLE
  WHEN 'type_like' THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END"""


def candidates(caps: str, always: int) -> str:
    """Needs ``hits`` and a view ``caps`` (query_id, cap)."""
    return f"""
arr AS (
  SELECT query_id, obs_id, step, row_number() OVER (PARTITION BY query_id ORDER BY step, pos, obs_id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, obs_id ORDER BY step, pos) AS rn FROM hits) a WHERE rn = 1),
room AS (
  SELECT s.query_id, s.step, c.cap, (SELECT count(*) FROM arr WHERE arr.query_id = s.query_id AND arr.step < s.step) AS before
  FROM (SELECT DISTINCT query_id, step FROM hits) s JOIN ({caps}) c ON c.query_id = s.query_id),
kept AS (
  SELECT h.* FROM hits h JOIN room r ON r.query_id = h.query_id AND r.step = h.step
  JOIN arr ON arr.query_id = h.query_id AND arr.obs_id = h.obs_id
  WHERE (h.step < {always} OR r.before < r.cap) AND arr.place <= r.cap),
cand AS (
  SELECT query_id, obs_id, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels,
         len(list_distinct(list(channel))) AS n_channels, max({_WEIGHT}) AS best_weight, min(fts_pos) AS fts_pos
  FROM kept GROUP BY query_id, obs_id)"""


def scored(half_life: str = "12.0") -> str:
    return f"""
sc AS (
  SELECT c.*, l.entity_id, l.content, l.source, l.access_count, l.created_at, l.event_id,
         e.name AS entity_name, e.entity_type, {decayed('l.', 'confidence', half_life)} AS eff,
         count(fts_pos) OVER (PARTITION BY query_id) AS with_text
  FROM cand c JOIN liv l ON l.id = c.obs_id JOIN ent e ON e.id = l.entity_id),
fin AS (
  SELECT *, 0.7::DOUBLE * (best_weight + CASE WHEN fts_pos IS NULL THEN 0::DOUBLE
      WHEN with_text <= 1 THEN 0.08::DOUBLE ELSE 0.08::DOUBLE * (1 - fts_pos / (with_text - 1)::DOUBLE) END
      + least(0.10::DOUBLE, 0.03::DOUBLE * (n_channels - 1))) + 0.3::DOUBLE * eff AS score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, round(eff, 12) DESC, obs_id) AS rank FROM fin)"""


def search(kind: str = "doc") -> str:
    """``WITH`` up to ``hits``."""
    return memory(kind, "m_queries") + "," + ",".join([_PREPARED, TEXT, _CHANNELS])


def recall() -> str:
    """``WITH`` up to ``ranked``."""
    parts = [
        search(), candidates("SELECT query_id, cap FROM q", 3), scored(),
        "ranked AS (SELECT rk.* FROM rk JOIN q ON q.query_id = rk.query_id WHERE rank <= keep)",
    ]
    return ",".join(parts)


def text_only() -> str:
    return memory("doc", "m_queries") + f""",
tp AS (
  SELECT query_id, phrase, count(*) AS times FROM (
    SELECT query_id, array_to_string({tokens('term')}, ' ') AS phrase
    FROM (SELECT query_id, unnest({clean('text')}) AS term FROM m_queries) a) b
  WHERE phrase <> '' GROUP BY query_id, phrase),
phr AS (SELECT DISTINCT phrase FROM tp),""" + TEXT


def hints(facts: str) -> str:
    """``WITH`` up to ``rk``; ``facts`` gives (query_id, entity_id, content)."""
    return memory("turn", "m_facts") + f""",
f AS (SELECT query_id, entity_id, {clean('content')} AS clean FROM ({facts}) x WHERE len({clean('content')}) > 0),
tp AS (
  SELECT query_id, entity_id, phrase, count(*) AS times FROM (
    SELECT query_id, entity_id, array_to_string({tokens('term')}, ' ') AS phrase
    FROM (SELECT query_id, entity_id, unnest(clean) AS term FROM f) a) b
  WHERE phrase <> '' GROUP BY query_id, entity_id, phrase),
wp AS (
  SELECT * FROM (SELECT query_id, entity_id, array_to_string({tokens("array_to_string(clean, ' ')")}, ' ') AS phrase
                 FROM f WHERE len(clean) > 1) a WHERE phrase <> ''),
phr AS (SELECT phrase FROM tp UNION SELECT phrase FROM wp),{TEXT},
texts AS (
  SELECT query_id, 1 AS step, 'fts' AS channel, obs_id, pos, pos AS fts_pos FROM (
    SELECT query_id, obs_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, obs_id) - 1 AS pos
    FROM (SELECT tp.query_id, wgt.obs_id, sum(weight * times) AS score FROM tp
          JOIN wgt ON wgt.phrase = tp.phrase AND wgt.entity_id = tp.entity_id GROUP BY tp.query_id, wgt.obs_id) a) b
  WHERE pos < 20
  UNION ALL
  SELECT query_id, 0, 'fts_phrase', obs_id, pos, pos FROM (
    SELECT wp.query_id, wgt.obs_id,
           row_number() OVER (PARTITION BY wp.query_id ORDER BY round(weight, 9) DESC, wgt.obs_id) - 1 AS pos
    FROM wp JOIN wgt ON wgt.phrase = wp.phrase AND wgt.entity_id = wp.entity_id) b WHERE pos < 20),
needles AS (SELECT query_id, entity_id, {ascii_lower('term')} AS term, no FROM (
    SELECT query_id, entity_id, unnest(clean) AS term, generate_subscripts(clean, 1) - 1 AS no FROM f) a),
low AS (SELECT id, entity_id, {ascii_lower('content')} AS content FROM liv),
inside AS (
  SELECT * FROM (SELECT n.entity_id, n.term, low.id AS obs_id,
      row_number() OVER (PARTITION BY n.entity_id, n.term ORDER BY low.id) - 1 AS pos
    FROM (SELECT DISTINCT entity_id, term FROM needles) n
    JOIN low ON low.entity_id = n.entity_id AND contains(low.content, n.term)) a WHERE pos < 20),
hits AS (
  SELECT * FROM texts
  UNION ALL SELECT n.query_id, 2 + n.no, 'content_like', i.obs_id, i.pos, CAST(NULL AS BIGINT)
  FROM needles n JOIN inside i ON i.entity_id = n.entity_id AND i.term = n.term),{candidates('SELECT query_id, 50 AS cap FROM f', 2)},{scored()}"""
