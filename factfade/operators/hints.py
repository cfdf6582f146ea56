"""Hints: visible rows of an entity that resemble a fact about to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.functions.text import ascii_lower, compact_snippet, query_terms, trim_white
from factfade.model import Memory
from factfade.operators.allrows import best_rows_of_all
from factfade.operators.postings import TextIndex
from factfade.operators.search import (
    cap_candidates,
    content_hits_while_room,
    hits_of,
    hydrate,
    merge_hits,
    score_candidates,
    term_phrases,
    whole_phrases,
)
from factfade.operators.textindex import best_rows, text_weights
from factfade.operators.visibility import live_observations
from factfade.session import materialize

# Fixed values of the hint search.
MIN_SCORE = 0.6
MOST_HINTS = 3
MOST_HITS = 20
MOST_CANDIDATES = 50
PHRASE, ANY_TERM, FIRST_TERM = 0, 1, 2


def conflict_hints(
    facts: DataFrame, mem: Memory, as_of, half_life, min_score: float = MIN_SCORE,
    k: int = MOST_HINTS, index: TextIndex | None = None,
) -> DataFrame:
    """(seq, rank, obs_id, similarity, snippet) for facts (seq, entity_id, content).

    Every fact is compared with the rows ``mem`` holds now; nothing is changed.
    """
    asked = materialize(
        facts.select(
            F.col("seq").alias("query_id"), "entity_id", F.lit(MOST_HITS).alias("collect"),
            query_terms(trim_white(F.col("content"))).alias("clean"),
        )
        .filter(F.size("clean") > 0),
        "asked",
    )
    owner = asked.select("query_id", "entity_id")
    # Cutting texts into words is slow and several steps read them.
    single = materialize(term_phrases(asked), "single-terms")
    whole = materialize(whole_phrases(asked, F.col("clean")), "whole-terms")
    phrases = materialize(
        single.select("phrase").unionByName(whole.select("phrase")).distinct(), "hint-phrases"
    )
    weights = text_weights(hits_of(phrases, mem, as_of, index))

    def by_text(terms: DataFrame, step: int, channel: str, best) -> DataFrame:
        keyed = terms.join(owner, "query_id").select(
            F.col("query_id").alias("key"), F.col("entity_id").alias("grp"), "phrase", "times",
            F.col("collect").alias("keep"),
        )
        return best(keyed, weights, MOST_HITS, F.col("entity_id")).select(
            F.col("key").alias("query_id"), F.lit(step).alias("step"),
            F.lit(channel).alias("channel"), "obs_id", "position",
            F.col("position").alias("fts_pos"),
        )

    steps = asked.select("query_id", "entity_id", F.posexplode("clean").alias("no", "term")).select(
        "query_id", "entity_id", (F.col("no") + FIRST_TERM).alias("step"),
        ascii_lower(F.col("term")).alias("needle"),
    )
    rows = (
        live_observations(mem, as_of)
        .join(owner.select("entity_id").distinct(), "entity_id", "left_semi")
        .select(F.col("id").alias("obs_id"), "entity_id", ascii_lower(F.col("content")).alias("text"))
    )
    texts = materialize(
        by_text(whole, PHRASE, "fts_phrase", best_rows)
        # All words of a fact: they meet nearly all rows of the entity.
        .unionByName(by_text(single, ANY_TERM, "fts", best_rows_of_all)),
        "hint-texts",
    )
    caps = asked.select("query_id", F.lit(MOST_CANDIDATES).alias("cap"))

    def numbered(wanted: DataFrame, contained: DataFrame) -> DataFrame:
        return wanted.join(contained, ["entity_id", "needle"]).select(
            "query_id", "step", F.lit("content_like").alias("channel"), "obs_id", "position",
            F.lit(None).cast("int").alias("fts_pos"),
        )

    contents = content_hits_while_room(
        steps, texts, caps, rows, MOST_HITS, numbered, ("entity_id",)
    )
    hits = materialize(texts.unionByName(contents), "hint-hits")
    candidates = materialize(merge_hits(cap_candidates(hits, caps, always=2)), "hint-candidates")
    keep = asked.select("query_id", F.lit(MOST_CANDIDATES).alias("keep"))
    # All candidates are dealt to be ranked: with their snippets, not their whole texts.
    hydrated = hydrate(candidates, mem, as_of).withColumn(
        "snippet", compact_snippet(F.col("content")).getField("content")
    ).drop("content")
    ranked = score_candidates(hydrated, keep, as_of, half_life, most=MOST_CANDIDATES)
    # Scores fall with the rank, so the first k rows above the bound are the best k.
    return ranked.filter((F.col("composite_score") >= min_score) & (F.col("rank") <= k)).select(
        F.col("query_id").alias("seq"), "rank", "obs_id",
        F.col("composite_score").alias("similarity"), "snippet",
    )
