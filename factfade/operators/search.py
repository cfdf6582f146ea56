"""Ranked search for a batch of queries over one fact table."""

from __future__ import annotations

from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.functions.privacy import hash_identifier
from factfade.functions.scoring import (
    COLLECT_FACTOR,
    MAX_RESULTS,
    MIN_CANDIDATE_CAP,
    channel_weight,
    composite_score,
    decayed_confidence,
    sanitize_limit,
)
from factfade.functions.text import (
    ascii_lower,
    compact_snippet,
    query_terms,
    raw_terms,
    tokens,
    trim_white,
)
from factfade.model import Memory
from factfade.operators.allrows import all_rows_of_all, best_rows_of_all
from factfade.operators.ordering import number_rows
from factfade.operators.postings import TextIndex
from factfade.operators.substrings import (
    has_many,
    lowest_ids,
    lowest_ids_containing,
    match_substrings,
    word_heads,
)
from factfade.operators.textindex import (
    RANK_DECIMALS,
    best_rows,
    phrase_hits,
    text_weights,
)
from factfade.operators.visibility import (
    active_events,
    live_entities,
    live_observations,
    with_live_event,
)
from factfade.session import at, materialize

# Steps of one search in the order in which they may add rows.  The first three
# always run; each later one only while there is room.
PHRASE, ANY_TERM, EXACT_NAME, NAME_PART, FIRST_TERM = 0, 1, 2, 3, 4
ALWAYS_RUN = 3

# Steps of a term channel that are looked up before it is known whether later ones run.
EARLY_STEPS = 8
#: Words of a query, on average, from which on a batch adds up all stored rows of its words.
LONG_TEXT = 8


def prepare_queries(queries: DataFrame) -> DataFrame:
    """(query_id, text, keep, collect, cap, terms, clean) of queries that can return rows."""
    keep = sanitize_limit(F.col("max_results"))
    prepared = (
        queries.select("query_id", trim_white(F.col("text")).alias("text"), keep.alias("keep"))
        .filter((F.col("keep") > 0) & (F.col("text") != ""))
        .withColumn("collect", F.col("keep") * COLLECT_FACTOR)
        .withColumn("cap", F.greatest(F.col("collect"), F.lit(MIN_CANDIDATE_CAP)))
        .withColumn("terms", raw_terms(F.col("text")))
        .withColumn("clean", query_terms(F.col("text")))
    )
    return materialize(prepared, "queries")


_MOST: "WeakKeyDictionary[DataFrame, int]" = WeakKeyDictionary()


def most_hits(prepared: DataFrame) -> int:
    """The largest number of hits any query of the batch takes from a channel.

    One small job per batch; the channels of a search share the answer, which is kept
    no longer than the batch itself.
    """
    if prepared not in _MOST:
        _MOST[prepared] = prepared.agg(F.max("collect")).first()[0] or 1
    return _MOST[prepared]


def _phrase_of(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def term_phrases(prepared: DataFrame) -> DataFrame:
    """(query_id, collect, phrase, times): a term of several tokens is a small phrase."""
    return (
        prepared.select("query_id", "collect", F.explode("clean").alias("term"))
        .withColumn("phrase", _phrase_of(F.col("term")))
        .filter(F.col("phrase") != "")
        .groupBy("query_id", "collect", "phrase").agg(F.count(F.lit(1)).alias("times"))
    )


def whole_phrases(prepared: DataFrame, terms: Column) -> DataFrame:
    """(query_id, collect, phrase, times) of queries with more than one term."""
    return (
        prepared.filter(F.size(terms) > 1)
        .select(
            "query_id", "collect",
            _phrase_of(F.array_join("clean", " ")).alias("phrase"),
            F.lit(1).cast("long").alias("times"),
        )
        .filter(F.col("phrase") != "")
    )


def _text_channel(
    terms: DataFrame, weights: DataFrame, step: int, channel: str, most: int, best
) -> DataFrame:
    keyed = terms.select(
        F.col("query_id").alias("key"), F.lit(0).alias("grp"), "phrase", "times",
        F.col("collect").alias("keep"),
    )
    return best(keyed, weights, most, F.lit(0)).select(
        F.col("key").alias("query_id"), F.lit(step).alias("step"), F.lit(channel).alias("channel"),
        "obs_id", "position", F.col("position").alias("fts_pos"),
    )


def fts_any_term_indexed(prepared: DataFrame, index: TextIndex, mem: Memory, as_of) -> DataFrame:
    """``fts_any_term`` from stored blocks, of which only those that can matter are opened.

    Of long texts nearly all blocks matter: their words are read once and added up whole.
    """
    terms = materialize(term_phrases(prepared), "indexed-terms")
    size = terms.agg(F.count(F.lit(1)).alias("words"), F.count_distinct("query_id").alias("keys")).first()
    if size["words"] > LONG_TEXT * size["keys"]:
        weights = index.weights(terms, mem, as_of)
        return _text_channel(terms, weights, ANY_TERM, "fts", most_hits(prepared), best_rows_of_all)
    keyed = terms.select(
        F.col("query_id").alias("key"), "phrase", "times", F.col("collect").alias("keep")
    )
    return index.best_rows(keyed, mem, as_of, most_hits(prepared)).select(
        F.col("key").alias("query_id"), F.lit(ANY_TERM).alias("step"),
        F.lit("fts").alias("channel"), "obs_id", "position", F.col("position").alias("fts_pos"),
    )


def fts_any_term(prepared: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with any term in any field, best text rank first."""
    return _text_channel(
        term_phrases(prepared), weights, ANY_TERM, "fts", most_hits(prepared), best_rows_of_all
    )


def fts_phrase(prepared: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with all terms next to each other in one field."""
    return _text_channel(
        whole_phrases(prepared, F.col("terms")), weights, PHRASE, "fts_phrase", most_hits(prepared),
        best_rows,
    )


def hits_of(phrases: DataFrame, mem: Memory, as_of, index: TextIndex | None = None) -> DataFrame:
    """Occurrences of phrases, from a stored index if there is one."""
    return phrase_hits(mem, as_of, phrases) if index is None else index.hits(phrases, mem, as_of)


def search_weights(
    prepared: DataFrame, mem: Memory, as_of, index: TextIndex | None = None
) -> DataFrame:
    phrases = whole_phrases(prepared, F.col("terms")).select("phrase")
    if index is None:  # single terms are ranked in the index itself
        phrases = phrases.unionByName(term_phrases(prepared).select("phrase"))
    return text_weights(hits_of(phrases.distinct(), mem, as_of, index))


def _named(mem: Memory) -> DataFrame:
    return live_entities(mem.entities).select(
        F.col("id").alias("entity_id"), ascii_lower(F.col("name")).alias("name"),
        ascii_lower(F.col("entity_type")).alias("kind"),
    )


def _whole_text(prepared: DataFrame, step: Column, channel: str) -> DataFrame:
    return prepared.select(
        "query_id", "collect", step.alias("step"), F.lit(channel).alias("channel"),
        ascii_lower(F.col("text")).alias("needle"),
    )


def _each_term(prepared: DataFrame, first: Column, channel: str) -> DataFrame:
    return prepared.select(
        "query_id", "collect", first.alias("first"), F.posexplode("terms").alias("no", "term")
    ).select(
        "query_id", "collect", (F.col("first") + F.col("no")).alias("step"),
        F.lit(channel).alias("channel"), ascii_lower(F.col("term")).alias("needle"),
    )


def _numbered(steps: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (channel, needle, obs_id, position) handed to the steps that asked for them."""
    return (
        steps.join(hits, ["channel", "needle"])
        .filter(F.col("position") < F.col("collect"))
        .select(
            "query_id", "step", "channel", "obs_id", "position",
            F.lit(None).cast("int").alias("fts_pos"),
        )
    )


def _rows_of(owners: DataFrame, key: str, mem: Memory, as_of, most: int) -> DataFrame:
    """First visible rows of matched entities or events per (channel, needle)."""
    seen = live_observations(mem, as_of).select(F.col("id").alias("obs_id"), key)
    return lowest_ids(
        owners.join(seen, key).select("channel", "needle", "obs_id"),
        ["channel", "needle"], most,
    )


def entity_exact(prepared: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Rows of the entity whose name is the whole query."""
    steps = _whole_text(prepared, F.lit(EXACT_NAME), "entity_exact")
    rows = _rows_of(_exact_owners(steps, mem), "entity_id", mem, as_of, most_hits(prepared))
    return _numbered(steps, rows)


def _exact_owners(steps: DataFrame, mem: Memory) -> DataFrame:
    return _named(mem).join(
        steps.select("needle", "channel").distinct(), F.col("name") == F.col("needle")
    ).select("entity_id", "channel", "needle")


def entity_like(prepared: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Rows of entities whose name contains the query but is not equal to it."""
    steps = _whole_text(prepared, F.lit(NAME_PART), "entity_like")
    rows = _rows_of(_like_owners(steps, mem), "entity_id", mem, as_of, most_hits(prepared))
    return _numbered(steps, rows)


def _like_owners(steps: DataFrame, mem: Memory) -> DataFrame:
    named = _named(mem)
    pairs = match_substrings(named.select(F.col("name").alias("text")), steps)
    return (
        named.join(pairs.filter(F.col("text") != F.col("needle")), F.col("name") == F.col("text"))
        .select("entity_id", F.lit("entity_like").alias("channel"), "needle")
    )


def type_like(prepared: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Rows of entities whose present type contains a term, one step per term."""
    steps = _each_term(prepared, FIRST_TERM + F.size("terms"), "type_like")
    rows = _rows_of(_type_owners(steps, mem), "entity_id", mem, as_of, most_hits(prepared))
    return _numbered(steps, rows)


def _type_owners(steps: DataFrame, mem: Memory) -> DataFrame:
    named = _named(mem).filter(F.col("kind").isNotNull())
    pairs = match_substrings(named.select(F.col("kind").alias("text")), steps)
    return named.join(pairs, F.col("kind") == F.col("text")).select(
        "entity_id", F.lit("type_like").alias("channel"), "needle"
    )


def event_label(prepared: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Rows of live events whose label contains the query."""
    steps = _whole_text(prepared, FIRST_TERM + 2 * F.size("terms"), "event_label")
    labelled = active_events(mem.events, as_of).select(
        F.col("id").alias("event_id"), ascii_lower(F.col("label")).alias("label")
    )
    pairs = match_substrings(labelled.select(F.col("label").alias("text")), steps)
    owners = labelled.join(pairs, F.col("label") == F.col("text")).select(
        "event_id", F.lit("event_label").alias("channel"), "needle"
    )
    rows = _rows_of(owners, "event_id", mem, as_of, most_hits(prepared))
    return _numbered(steps, rows)


def _contents(mem: Memory, as_of) -> DataFrame:
    return live_observations(mem, as_of).select(
        F.col("id").alias("obs_id"), ascii_lower(F.col("content")).alias("text")
    )


def content_like(prepared: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Rows whose content contains a term (quote marks kept), one step per term."""
    steps = _each_term(prepared, F.lit(FIRST_TERM), "content_like")
    hits = lowest_ids_containing(_contents(mem, as_of), steps, most_hits(prepared))
    return _numbered(steps, hits.withColumn("channel", F.lit("content_like")))


def content_hits_while_room(
    steps: DataFrame, before: DataFrame, caps: DataFrame, rows: DataFrame, most: int, number,
    groups: tuple[str, ...] = (),
) -> DataFrame:
    """Content hits of the steps that can still count, in two stages.

    A long text has many terms, but once its list is full no later term runs.  The
    first few terms are looked up for everyone, the others only for texts whose
    list they leave with room.  A repeated term adds nothing to its first step.
    ``number`` turns (steps, hits per needle) into hits per step.
    """
    keys = [c for c in steps.columns if c != "step"]
    order = Window.partitionBy("query_id").orderBy("step")
    steps = materialize(
        steps.groupBy(*keys).agg(F.min("step").alias("step"))
        .withColumn("nth", F.row_number().over(order)),
        "steps",
    )
    heads = word_heads(rows, most, groups) if has_many(steps) else None

    def look_up(asked: DataFrame) -> DataFrame:
        return number(asked, lowest_ids_containing(rows, asked, most, groups, heads))

    early = materialize(
        look_up(steps.filter(F.col("nth") <= EARLY_STEPS).drop("nth")), "early"
    )
    full = (
        before.select("query_id", "obs_id").unionByName(early.select("query_id", "obs_id"))
        .distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        .join(caps, "query_id").filter(F.col("n") >= F.col("cap")).select("query_id")
    )
    late = materialize(
        steps.filter(F.col("nth") > EARLY_STEPS).drop("nth").join(full, "query_id", "left_anti"),
        "late-steps",
    )
    return early.unionByName(look_up(late))


def channel_hits(
    prepared: DataFrame, mem: Memory, as_of, only_while_room: bool = False,
    index: TextIndex | None = None,
) -> DataFrame:
    """Hits of all channels: (query_id, step, channel, obs_id, position, fts_pos).

    The three entity channels share one pass over the visible rows.  With
    ``only_while_room`` terms that can no longer run are not looked up.
    """
    weights = search_weights(prepared, mem, as_of, index)
    any_term = (
        fts_any_term(prepared, weights) if index is None
        else fts_any_term_indexed(prepared, index, mem, as_of)
    )
    exact = _whole_text(prepared, F.lit(EXACT_NAME), "entity_exact")
    like = _whole_text(prepared, F.lit(NAME_PART), "entity_like")
    kind = _each_term(prepared, FIRST_TERM + F.size("terms"), "type_like")
    owners = (
        _exact_owners(exact, mem).unionByName(_like_owners(like, mem))
        .unionByName(_type_owners(kind, mem))
    )
    by_entity = _numbered(
        exact.unionByName(like).unionByName(kind),
        _rows_of(owners, "entity_id", mem, as_of, most_hits(prepared)),
    )
    text = [fts_phrase(prepared, weights), any_term, by_entity]
    others = materialize(
        reduce(DataFrame.unionByName, [*text, event_label(prepared, mem, as_of)]), "channels"
    )
    if not only_while_room:
        return others.unionByName(content_like(prepared, mem, as_of))
    content = content_hits_while_room(
        _each_term(prepared, F.lit(FIRST_TERM), "content_like"),
        others.filter(F.col("step") < FIRST_TERM), prepared.select("query_id", "cap"),
        _contents(mem, as_of), most_hits(prepared),
        lambda steps, hits: _numbered(steps, hits.withColumn("channel", F.lit("content_like"))),
    )
    return materialize(others.unionByName(content), "channels")


def merge_hits(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per (query, observation): set of channels, best weight, best text position."""
    return hits.groupBy(key, "obs_id").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.max(channel_weight(F.col("channel"))).alias("best_weight"),
        F.min("fts_pos").alias("fts_pos"),
    )


def cap_candidates(
    hits: DataFrame, caps: DataFrame, key: str = "query_id", always: int = ALWAYS_RUN
) -> DataFrame:
    """Hits that count when at most ``cap`` distinct rows are taken in order of arrival.

    Rows arrive by (step, position).  Once full, new rows are dropped but rows
    already in still gain channels; a step after the first ``always`` ones runs
    only if there was room before it.
    """
    arrival = hits.groupBy(key, "obs_id").agg(
        F.min(F.struct("step", "position")).alias("first")
    )
    order = Window.partitionBy(key).orderBy("first", "obs_id")
    ranked = arrival.withColumn("arrival", F.row_number().over(order)).join(caps, key)
    taken = ranked.filter(F.col("arrival") <= F.col("cap")).select(key, "obs_id")
    # The step in which the cap is reached is the last optional one to run.
    full = ranked.filter(F.col("arrival") == F.col("cap")).select(
        key, F.col("first.step").alias("full_at")
    )
    return (
        hits.join(taken, [key, "obs_id"])
        .join(full, key, "left")
        .filter(
            (F.col("step") < always) | F.col("full_at").isNull()
            | (F.col("step") <= F.col("full_at"))
        )
        .drop("full_at")
    )


def collect_candidates(
    prepared: DataFrame, mem: Memory, as_of, index: TextIndex | None = None
) -> DataFrame:
    """(query_id, obs_id, channels, best_weight, fts_pos) of a batch of queries."""
    hits = channel_hits(prepared, mem, as_of, only_while_room=True, index=index)
    capped = cap_candidates(hits, prepared.select("query_id", "cap"))
    return materialize(merge_hits(capped), "candidates")


def hydrate(candidates: DataFrame, mem: Memory, as_of) -> DataFrame:
    """Candidates with their visible row, entity (present type) and event."""
    wanted = mem.observations.join(
        candidates.select(F.col("obs_id").alias("id")).distinct(), "id", "left_semi"
    ).filter(F.col("deleted_at").isNull() & F.col("superseded_by").isNull())
    owners = live_entities(mem.entities).select(
        F.col("id").alias("entity_id"), F.col("name").alias("entity_name"),
        F.col("entity_type").alias("owner_type"),
    )
    rows = (
        with_live_event(
            wanted, mem.events, as_of, F.col("label").alias("event_label"), F.col("event_date"),
            F.col("event_type"),
        )
        .join(owners, "entity_id")
        .select(
            F.col("id").alias("obs_id"), "entity_id", "entity_name",
            F.col("owner_type").alias("entity_type"), "content", "source",
            F.col("confidence").alias("stored_confidence"), "access_count", "created_at",
            "event_id", "event_label", "event_date", "event_type",
        )
    )
    return candidates.join(rows, "obs_id")


def score_candidates(
    hydrated: DataFrame, keep: DataFrame, as_of, half_life, key: str = "query_id",
    most: int = MAX_RESULTS,
) -> DataFrame:
    """Effective confidence, composite score and rank; the best ``keep`` rows per key.

    ``keep`` is (key, keep).  A key has no more candidates than its cap.
    """
    # Counted beside the ranking: a window over the whole key would need all its rows
    # in one task, while the ranking alone drops rows inside each task.
    texts = hydrated.groupBy(key).agg(F.count("fts_pos").alias("with_text"))
    order = Window.partitionBy(key).orderBy(
        F.desc("composite_score"), F.desc("confidence"), "obs_id"
    )
    return (
        hydrated.join(texts, key)
        .withColumn(
            "confidence",
            decayed_confidence(
                F.col("created_at"), F.col("stored_confidence"), F.col("access_count"),
                half_life, as_of,
            ),
        )
        .withColumn(
            "composite_score",
            composite_score(
                F.col("best_weight"), F.size("channels"), F.col("fts_pos"), F.col("with_text"),
                F.col("confidence"),
            ),
        )
        .join(keep, key)
        .withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= most) & (F.col("rank") <= F.col("keep")))
        .drop("keep", "with_text")
    )


def recall_from(candidates: DataFrame, prepared: DataFrame, mem: Memory, as_of, half_life) -> DataFrame:
    return score_candidates(
        hydrate(candidates, mem, as_of), prepared.select("query_id", "keep"), as_of, half_life
    )


def recall(
    queries: DataFrame, mem: Memory, as_of, half_life, index: TextIndex | None = None
) -> DataFrame:
    """Ranked rows of a batch of queries (query_id, text, max_results).

    With a stored ``index`` of ``mem`` no text is cut into words.
    """
    prepared = prepare_queries(queries)
    candidates = collect_candidates(prepared, mem, as_of, index)
    return recall_from(candidates, prepared, mem, as_of, half_life)


def channel_counts(candidates: DataFrame) -> DataFrame:
    """Candidates seen by each channel."""
    return (
        candidates.select("query_id", F.explode("channels").alias("channel"))
        .groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("candidates"))
    )


def score_stats(queries: DataFrame, candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """Counts and lowest, highest and median score of every query; zeros if empty."""
    seen = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_total"))
    scores = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results_returned"),
        F.min("composite_score").alias("score_min"),
        F.max("composite_score").alias("score_max"),
        F.percentile("composite_score", 0.5).alias("score_median"),
    )
    filled = {
        "candidates_total": 0, "results_returned": 0,
        "score_min": 0.0, "score_max": 0.0, "score_median": 0.0,
    }
    return (
        queries.select(
            "query_id", trim_white(F.col("text")).alias("query"),
            F.col("max_results").alias("limit_requested"),
        )
        .join(seen, "query_id", "left").join(scores, "query_id", "left")
        .fillna(filled)
    )


def search_metrics(
    queries: DataFrame, candidates: DataFrame, ranked: DataFrame, compact: bool = False,
    strict: bool = False,
) -> DataFrame:
    """The log row of each query: ``score_stats`` and the channel counts as a map.

    ``strict`` keeps a hash in place of the query.  A batch search fails as a whole or
    not at all, so ``fts_query_errors`` is 0.
    """
    channels = channel_counts(candidates).groupBy("query_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("channel", "candidates")))
        ).alias("channels")
    )
    empty = F.create_map().cast("map<string,bigint>")
    return (
        score_stats(queries, candidates, ranked).join(channels, "query_id", "left")
        .withColumn("channels", F.coalesce("channels", empty))
        .withColumn("query", hash_identifier(F.col("query"), strict))
        .withColumn("fts_query_errors", F.lit(0).cast("long"))
        .withColumn("compact", F.lit(compact))
    )


def recall_grouped(ranked: DataFrame, compact: bool = False) -> DataFrame:
    """Ranked rows of each query grouped by entity name in order of first appearance.

    A query returns at most 200 rows, which bounds the arrays.
    """
    content = F.col("content")
    text = compact_snippet(content) if compact else F.struct(
        content.alias("content"), F.lit(False).alias("truncated")
    )
    row = F.struct(
        "rank", F.col("obs_id").alias("id"), text.getField("content").alias("content"),
        text.getField("truncated").alias("truncated"), "confidence", "composite_score", "source",
        "access_count", "created_at", "event_id", "event_label", "event_date",
    )
    groups = ranked.groupBy("query_id", "entity_name").agg(
        F.min("rank").alias("first_rank"),
        F.min_by("entity_type", "rank").alias("entity_type"),
        F.array_sort(F.collect_list(row)).alias("observations"),
    )
    order = Window.partitionBy("query_id").orderBy("first_rank")
    total = Window.partitionBy("query_id")
    return groups.select(
        "query_id", F.row_number().over(order).alias("group_no"), "entity_name", "entity_type",
        "observations", F.sum(F.size("observations")).over(total).alias("total_facts"),
    )


def counted_accesses(mem: Memory, returned: DataFrame, as_of) -> DataFrame:
    """(id, _times): how often each visible row was returned, rows not returned left out."""
    times = returned.groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    seen = live_observations(
        Memory(
            mem.entities, mem.observations.join(times.select("id"), "id", "left_semi"), mem.events
        ),
        as_of,
    ).select("id")
    return times.join(seen, "id")


def touch(mem: Memory, returned: DataFrame, as_of) -> DataFrame:
    """Observations after a read: +1 access for each time a visible row was returned.

    ``returned`` has a column ``id`` and may name a row several times.  ``marks.Marks``
    writes the counts alone.
    """
    counted = counted_accesses(mem, returned, as_of)
    columns = mem.observations.columns
    return (
        mem.observations.join(counted, "id", "left")
        .withColumn("access_count", F.col("access_count") + F.coalesce("_times", F.lit(0)))
        .withColumn(
            "last_accessed", F.when(F.col("_times").isNotNull(), at(as_of))
            .otherwise(F.col("last_accessed"))
        )
        .select(*columns)
    )


def text_match_ids(
    queries: DataFrame, mem: Memory, as_of, index: TextIndex | None = None
) -> DataFrame:
    """All visible rows with any term of a query: no limit.

    ``pos`` numbers the rows of a query from 1 by ``text_rank`` (lower is better), then
    id.  All rows are numbered together over ranges, so no query is one task.
    """
    asked = queries.select(
        "query_id", F.lit(0).alias("collect"), query_terms(F.col("text")).alias("clean")
    )
    terms = materialize(term_phrases(asked), "match-terms")
    weights = text_weights(hits_of(terms.select("phrase").distinct(), mem, as_of, index))
    ranked = materialize(
        all_rows_of_all(
            terms.select(F.col("query_id").alias("key"), "phrase", "times"),
            weights.select("phrase", "obs_id", "weight"),
        ).select(
            F.col("key").alias("query_id"), "obs_id",
            (-F.col("units") / 10.0**RANK_DECIMALS).alias("text_rank"),
        ),
        "text-ranks",
    )
    numbered = number_rows(ranked, [F.col(c) for c in ("query_id", "text_rank", "obs_id")], "no")
    first = numbered.groupBy("query_id").agg(F.min("no").alias("first"))
    return numbered.join(first, "query_id").select(
        "query_id", "obs_id", "text_rank", (F.col("no") - F.col("first") + 1).alias("pos")
    )
