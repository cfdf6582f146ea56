"""Scores: decay with age, position in a text ranking, the composite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factfade.session import at

# Fixed values of the ranking.
CHANNEL_WEIGHTS = {
    "fts_phrase": 1.15,
    "fts": 1.0,
    "entity_exact": 0.9,
    "entity_like": 0.7,
    "content_like": 0.5,
    "type_like": 0.45,
    "event_label": 0.4,
}
HALF_LIFE_GLOBAL = 12.0
HALF_LIFE_PROJECT = 52.0
MAX_RESULTS = 200
COLLECT_FACTOR = 3
MIN_CANDIDATE_CAP = 200
WEEK_MICROS = 7 * 86400 * 1_000_000


def decayed_confidence(
    created_at: Column, confidence: Column, access_count: Column, half_life, as_of
) -> Column:
    """Confidence halved once per half-life, stretched by the number of accesses."""
    hl = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    hl = F.when(hl == 0, F.lit(HALF_LIFE_GLOBAL)).otherwise(hl)
    stability = hl * (1 + F.log2(access_count.cast("double") + 1))
    age_weeks = F.timestamp_diff("MICROSECOND", created_at, at(as_of)) / F.lit(float(WEEK_MICROS))
    faded = confidence * F.pow(F.lit(0.5), age_weeks / stability)
    return F.when(created_at.isNull() | (stability <= 0), confidence).otherwise(
        F.least(faded, confidence)
    )


def fts_position_score(position: Column, total: Column) -> Column:
    """1 for the first hit, 0 for the last; may pass 0 when hits were dropped."""
    return F.when(total <= 1, F.lit(1.0)).otherwise(1.0 - position / (total - 1))


def composite_score(
    best_weight: Column, n_channels: Column, position: Column, total: Column, memory: Column
) -> Column:
    text = F.when(
        position.isNotNull() & (total > 0), fts_position_score(position, total) * 0.08
    ).otherwise(F.lit(0.0))
    bonus = F.least(F.lit(0.10), (n_channels - 1) * 0.03)
    return (best_weight + text + bonus) * 0.7 + memory * 0.3


def sanitize_limit(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(MAX_RESULTS)))


def channel_weight(channel: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in CHANNEL_WEIGHTS.items() for x in kv])
    return F.element_at(weights, channel)
