"""Full-text side of the search: postings, phrase hits, BM25, exact top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.functions.text import tokens
from factfade.model import Memory
from factfade.operators.visibility import active_events, spread_nulls
from factfade.session import materialize

# Okapi BM25 with its usual parameters and a floor for the weight
# of words that most rows contain.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
RANK_DECIMALS = 9

# Two marks no token can equal: they keep phrases from crossing fields, and the
# second one occurs exactly once per row, which lets one pass count the rows.
_FIELD_BREAK = "|"
_ROW_MARK = ""

# A batch of phrases up to this many bytes is sent to every executor.
BROADCAST_BYTES = 16 * 1024 * 1024

# Words that make up at least one in so many of all words count as common.
COMMON_WORDS = 100_000

# Slack for rounding when rows are ruled out by their best possible score: ten steps of
# the rounded score, as words that nearly all rows hold differ by little more.
_SLACK = 10.0 ** (1 - RANK_DECIMALS)


def indexed_rows(mem: Memory, as_of) -> DataFrame:
    """Rows in the text index with their tokens and whether they are visible.

    Rows leave the index on deletion only: superseded and expired rows stay and
    count in the statistics.  Name and type are as they were written.
    """
    owners = mem.entities.select(
        F.col("id").alias("entity_id"), tokens(F.col("name")).alias("name_tokens"),
        F.col("deleted_at").isNull().alias("owner_live"),
    )
    live_events = active_events(mem.events, as_of).select(F.col("id").alias("_event"))
    rows = mem.observations.filter(F.col("deleted_at").isNull()).select(
        "id", "entity_id", "event_id", "superseded_by", "content", "entity_type"
    )
    return (
        rows.join(owners, "entity_id", "left")
        .join(live_events, spread_nulls(F.col("event_id"), F.col("id")) == F.col("_event"), "left")
        .select(
            F.col("id").alias("obs_id"),
            "entity_id",
            (
                F.col("superseded_by").isNull()
                & F.coalesce("owner_live", F.lit(False))
                & (F.col("event_id").isNull() | F.col("_event").isNotNull())
            ).alias("live"),
            F.coalesce("name_tokens", F.array().cast("array<string>")).alias("name_tokens"),
            tokens(F.col("content")).alias("content_tokens"),
            tokens(F.col("entity_type")).alias("type_tokens"),
        )
    )


def postings(mem: Memory, as_of) -> DataFrame:
    """(obs_id, field, pos, token) of every row in the text index."""
    rows = indexed_rows(mem, as_of)
    fields = {"entity_name": "name_tokens", "content": "content_tokens", "entity_type": "type_tokens"}

    def entries(field: str, column: str) -> Column:
        return F.transform(
            F.col(column),
            lambda t, i: F.struct(
                F.lit(field).alias("field"), i.cast("long").alias("pos"), t.alias("token")
            ),
        )

    return rows.select(
        "obs_id", F.inline(F.concat(*[entries(f, c) for f, c in fields.items()]))
    )


def _anchored(phrases: DataFrame) -> DataFrame:
    """Each phrase with its longest word, by which occurrences are looked up."""
    words = F.split("phrase", " ")
    lengths = F.transform(words, F.length)
    return phrases.select(
        "phrase",
        words.alias("phrase_words"),
        F.size(words).alias("n_words"),
        F.array_position(lengths, F.array_max(lengths)).cast("int").alias("anchor_no"),
    ).withColumn("token", F.element_at("phrase_words", F.col("anchor_no")))


def _is_small(phrases: DataFrame) -> bool:
    size = phrases.agg(F.sum(F.octet_length("phrase") * 2 + 64)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def phrase_hits(mem: Memory, as_of, phrases: DataFrame) -> DataFrame:
    """Occurrences of phrases (words joined by single blanks) in the text index.

    Returns (phrase, obs_id, entity_id, live, tf, row_tokens).  One extra row with
    an empty phrase holds the row count in ``tf`` and the token count of the whole
    index in ``all_tokens``.  The result is written once: every later step reads
    it, the texts are read a single time.
    """
    rows = indexed_rows(mem, as_of).select(
        "obs_id", "entity_id", "live",
        (F.size("name_tokens") + F.size("content_tokens") + F.size("type_tokens")).alias("row_tokens"),
        F.concat(
            "name_tokens", F.array(F.lit(_FIELD_BREAK)), "content_tokens",
            F.array(F.lit(_ROW_MARK)), "type_tokens",
        ).alias("words"),
    )
    spot = F.col("at") + 2 - F.col("anchor_no")  # 1-based start of the phrase
    found = (F.col("n_words") == 1) | (
        (spot >= 1) & (F.slice("words", F.greatest(spot, F.lit(1)), F.col("n_words"))
                       == F.col("phrase_words"))
    )
    if _is_small(phrases):
        mark = phrases.sparkSession.createDataFrame([(_ROW_MARK,)], "phrase string")
        wanted = _anchored(phrases.unionByName(mark))
        each = rows.select("*", F.posexplode("words").alias("at", "token"))
        # Phrases are verified against the words of the row inside the join, so
        # only true occurrences leave it.
        hits = each.join(F.broadcast(wanted), "token").filter(found)
        is_mark = F.col("phrase") == _ROW_MARK
        none = phrases.sparkSession.range(1).select(  # an empty index has no rows to count
            F.lit(_ROW_MARK).alias("phrase"), F.lit(None).cast("long").alias("obs_id"),
            F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("boolean").alias("live"),
            F.lit(0).alias("row_tokens"), F.lit(0).alias("times"),
        )
        hits = (
            hits.select("phrase", "obs_id", "entity_id", "live", "row_tokens", F.lit(1).alias("times"))
            .unionByName(none)
            .groupBy(
                "phrase",
                F.when(~is_mark, F.col("obs_id")).alias("obs_id"),
                F.when(~is_mark, F.col("entity_id")).alias("entity_id"),
                F.when(~is_mark, F.col("live")).alias("live"),
            )
            .agg(
                F.sum("times").alias("tf"), F.max("row_tokens").alias("row_tokens"),
                F.sum("row_tokens").alias("all_tokens"),
            )
        )
    else:
        rows = materialize(rows, "index-words")
        each = rows.select(
            "obs_id", "entity_id", "live", "row_tokens",
            F.posexplode("words").alias("at", "token"),
        ).filter(~F.col("token").isin(_FIELD_BREAK, _ROW_MARK))
        blank = F.contains("phrase", F.lit(" "))
        single = each.join(phrases.filter(~blank).select("phrase"), each["token"] == F.col("phrase"))
        several = _several_hits(phrases.filter(blank), rows, each)
        keys = ["phrase", "obs_id", "entity_id", "live", "row_tokens"]
        hits = (
            single.select(*keys).unionByName(several.select(*keys))
            .groupBy("phrase", "obs_id", "entity_id", "live")
            .agg(
                F.count(F.lit(1)).alias("tf"), F.max("row_tokens").alias("row_tokens"),
                F.lit(None).cast("long").alias("all_tokens"),
            )
        )
        totals = rows.agg(
            F.lit(_ROW_MARK).alias("phrase"), F.lit(None).cast("long").alias("obs_id"),
            F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("boolean").alias("live"),
            F.count(F.lit(1)).alias("tf"), F.max("row_tokens").alias("row_tokens"),
            F.sum("row_tokens").alias("all_tokens"),
        )
        hits = hits.unionByName(totals)
    return materialize(hits, "hits")


def _several_hits(phrases: DataFrame, rows: DataFrame, each: DataFrame) -> DataFrame:
    """Occurrences of phrases of several words, looked up by the rarest word of each.

    Only the numbers of a phrase and a row travel until a digest of the words in that
    place is the digest of the phrase; what is left is compared word by word.
    """
    words = F.split("phrase", " ")
    sought = materialize(
        phrases.distinct().select(
            F.monotonically_increasing_id().alias("no"), "phrase", words.alias("phrase_words"),
            F.size(words).alias("n_words"), F.xxhash64(words).alias("digest"),
        ),
        "phrases",
    )
    # Of all words only the common ones, a bounded number, are sent to every executor.
    counts = materialize(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / COMMON_WORDS
    common = counts.filter(F.col("n") >= least)
    anchors = (
        sought.select("no", "n_words", "digest", F.posexplode("phrase_words").alias("place", "token"))
        .join(F.broadcast(common), "token", "left")
        .groupBy("no", "n_words", "digest")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "place", "token"))
            .alias("rare")
        )
        .select("no", "n_words", "digest", "rare.place", "rare.token")
    )
    start = F.col("at") + 1 - F.col("place")  # 1-based
    near = each.join(anchors, "token").filter(start >= 1).select(
        "no", "n_words", "digest", start.alias("start"), "obs_id", "entity_id", "live", "row_tokens"
    )
    place = F.slice("words", F.col("start"), F.col("n_words"))
    like = near.join(rows.select("obs_id", "words"), "obs_id").withColumn("place", place).filter(
        F.xxhash64("place") == F.col("digest")
    )
    return like.join(sought.select("no", "phrase", "phrase_words"), "no").filter(
        F.col("place") == F.col("phrase_words")
    )


def text_weights(hits: DataFrame) -> DataFrame:
    """BM25 weight of each phrase in each visible row: (phrase, obs_id, entity_id, weight)."""
    totals = hits.filter(F.col("phrase") == _ROW_MARK)
    n_rows = totals.select("tf").scalar()
    mean_tokens = totals.select(F.col("all_tokens") / F.col("tf")).scalar()
    real = hits.filter(F.col("phrase") != _ROW_MARK)
    # One row per phrase: written once, as the weights are used several times.
    idf = materialize(
        real.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).select(
            "phrase",
            F.greatest(
                F.lit(IDF_FLOOR), F.log((n_rows - F.col("n") + 0.5) / (F.col("n") + 0.5))
            ).alias("idf"),
            mean_tokens.alias("mean_tokens"),
        ),
        "idf",
    )
    length = K1 * (1 - B + B * F.col("row_tokens") / F.col("mean_tokens"))
    return real.filter("live").join(idf, "phrase").select(
        "phrase", "obs_id", "entity_id",
        (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("weight"),
    )


def exact_sum(weight: Column) -> Column:
    """The sum of weights as a decimal: rows with the same words tie in any order of adding.

    Sums of doubles differ in their last digits with the order in which a shuffle brings
    the terms, which moves a rounded rank and so the place of a copy among its like.
    """
    return F.sum(weight.cast("decimal(38,18)"))


def best_rows(
    terms: DataFrame, weights: DataFrame, most: int, group: Column, margin: float = _SLACK
) -> DataFrame:
    """The rows with the highest sum of term weights, exactly: (key, obs_id, position).

    ``terms`` is (key, grp, phrase, times, keep); ``group`` says which rows of
    ``weights`` a key may use.  ``most`` bounds ``keep``.

    Common words would pair every query with nearly every row.  The best few rows
    per word give a score that ``keep`` rows are sure to reach; words that even
    together cannot reach it (the "max score" rule) bring in no rows of their
    own and are only added up for rows that a rarer word brought in.  A word that does
    bring rows brings those alone that can reach the score with the best of all others.
    """
    weights = weights.select(group.alias("grp"), "phrase", "obs_id", "weight")
    by_weight = Window.partitionBy("grp", "phrase").orderBy(F.desc("weight"), "obs_id")
    heads = weights.withColumn("rn", F.row_number().over(by_weight)).filter(F.col("rn") <= most)
    peaks = heads.filter(F.col("rn") == 1).select("grp", "phrase", F.col("weight").alias("peak"))
    split = bringing_terms(terms, heads, peaks, most, margin)
    return score_of_rank(add_common(split, weights, lambda rows: weights, most, margin), most)


def _reached(parts: DataFrame, most: int) -> DataFrame:
    """(key, sure): the score that ``keep`` rows have reached, from (key, keep, obs_id, part)."""
    by_part = Window.partitionBy("key").orderBy(F.desc("part"), "obs_id")
    return (
        parts.withColumn("rn", F.row_number().over(by_part))
        .filter((F.col("rn") <= most) & (F.col("rn") == F.col("keep")))
        .select("key", F.col("part").alias("sure"))
    )


def bringing_terms(
    terms: DataFrame, heads: DataFrame, peaks: DataFrame, most: int, margin: float
) -> DataFrame:
    """Terms with ``best``, whether each ``brings_rows``, and the ``floor`` of those it brings.

    ``heads`` (grp, phrase, obs_id, weight) holds some good rows of each phrase, ``peaks``
    (grp, phrase, peak) a weight that none exceeds.
    """
    reached = _reached(
        terms.join(heads, ["grp", "phrase"])
        .groupBy("key", "keep", "obs_id").agg(F.sum(F.col("weight") * F.col("times")).alias("part")),
        most,
    )
    rising = (
        Window.partitionBy("key").orderBy("best", "phrase")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return materialize(
        terms.join(peaks, ["grp", "phrase"])
        .withColumn("best", F.col("peak") * F.col("times"))
        .withColumn("together", F.sum("best").over(rising))
        .withColumn("all_best", F.sum("best").over(Window.partitionBy("key")))
        .join(reached, "key", "left")
        .withColumn(
            "brings_rows",
            F.col("sure").isNull() | (F.col("together") >= F.col("sure") - margin),
        )
        .withColumn(
            "floor",
            F.coalesce(F.col("sure") - (F.col("all_best") - F.col("best")), F.lit(0.0)),
        )
        .select("key", "grp", "phrase", "times", "keep", "best", "brings_rows", "floor"),
        "terms",
    )


def add_common(
    split: DataFrame, weights: DataFrame, of_rows: Callable[[DataFrame], DataFrame], most: int,
    margin: float,
) -> DataFrame:
    """(key, keep, obs_id, score) of the rows that can be among the best.

    ``weights`` holds all weights at or above the floors; ``of_rows`` gives the weights of
    the terms that bring no rows, in given rows (obs_id) at least.
    """
    rows = materialize(
        split.filter("brings_rows").join(weights, ["grp", "phrase"])
        .filter(F.col("weight") * F.col("times") >= F.col("floor") - margin)
        .groupBy("key", "grp", "keep", "obs_id")
        .agg(F.sum(F.col("weight") * F.col("times")).alias("part")),
        "scored",
    )
    # These sums are a better bound than the heads gave: rows that cannot reach it
    # even with the best of all common words are done with.
    common = split.filter(~F.col("brings_rows")).groupBy("key").agg(
        F.collect_list(F.struct("phrase", "times")).alias("common"),
        F.sum("best").alias("common_best"),
    )
    hopeful = F.col("sure").isNull() | (
        F.col("part") + F.coalesce("common_best", F.lit(0.0)) >= F.col("sure") - margin
    )
    hoped = materialize(
        rows.join(_reached(rows, most), "key", "left").join(common, "key", "left").filter(hopeful)
        .select("key", "grp", "keep", "obs_id", "part", F.explode_outer("common").alias("c"))
        .select("key", "grp", "keep", "obs_id", "part", "c.phrase", "c.times"),
        "hopeful",
    )
    return (
        hoped.join(of_rows(hoped.select("obs_id").distinct()), ["grp", "phrase", "obs_id"], "left")
        .groupBy("key", "keep", "obs_id")
        .agg(
            (F.max("part") + F.coalesce(F.sum(F.col("weight") * F.col("times")), F.lit(0.0)))
            .alias("score")
        )
    )


def score_of_rank(scored: DataFrame, most: int) -> DataFrame:
    """(key, obs_id, position) of the best ``keep`` rows of each key."""
    by_score = Window.partitionBy("key").orderBy(F.desc(F.round("score", RANK_DECIMALS)), "obs_id")
    return (
        scored.withColumn("rn", F.row_number().over(by_score))
        .filter((F.col("rn") <= most) & (F.col("rn") <= F.col("keep")))
        .select("key", "obs_id", (F.col("rn") - 1).alias("position"))
    )
