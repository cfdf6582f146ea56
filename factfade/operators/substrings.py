"""Substring search for many needles at once, without pairing all texts with all needles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.functions.text import split_white
from factfade.session import materialize

# Up to this many needles are tested one by one inside the scan of the texts, and
# up to that many against each distinct word.
FEW = 64
FEW_PER_WORD = 512


def _few(needles: DataFrame, most: int) -> list[str] | None:
    """The distinct needles if there are at most ``most``, else None."""
    head = needles.select("needle").distinct().limit(most + 1).collect()
    return None if len(head) > most else sorted(r["needle"] for r in head)


def lowest_ids(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key by obs_id, numbered from 0.

    The limit is applied before the shuffle as well, so a hot key stays small.
    """
    order = Window.partitionBy(*keys).orderBy("obs_id")
    return (
        df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
        .withColumn("position", F.col("rn") - 1).drop("rn")
    )


def _test_each(df: DataFrame, text: str, needles: list[str]) -> DataFrame:
    # One constant for the whole list; the optimizer folds it.
    listed = F.from_json(F.lit(json.dumps(needles)), "array<string>")
    # Needles that do not occur are dropped inside the row, before it is repeated.
    found = F.filter(listed, lambda needle: F.contains(F.col(text), needle))
    return df.select("*", F.explode(found).alias("needle"))


def _runs(c: Column, n: int) -> Column:
    """All runs of ``n`` characters; NULL-free, empty for shorter texts."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(c, i, n))
    # Cutting at every place is quadratic, so long texts go through a pattern.
    return F.when(F.char_length(c) < n, F.array().cast("array<string>")).when(
        F.char_length(c) <= 64, cut
    ).otherwise(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _grams(c: Column) -> Column:
    """Distinct runs of one, two and three characters."""
    return F.array_distinct(F.concat(*[_runs(c, n) for n in (1, 2, 3)]))


def _needle_grams(c: Column) -> Column:
    size = F.least(F.char_length(c), F.lit(3))
    pattern = F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(c, pattern, F.lit(1)))


def match_substrings(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs (text, needle) where the distinct ``text`` contains the ``needle``.

    Many needles meet texts over the rarest three-character run of the needle, an
    ordinary equi-join, and are then verified.
    """
    texts = texts.select("text").distinct()
    few = _few(needles, FEW_PER_WORD)
    if few is not None:
        return _test_each(texts, "text", few)
    sought = (
        needles.select("needle").distinct().filter(F.col("needle") != "")
        .select("needle", F.explode(_needle_grams(F.col("needle"))).alias("gram"))
    )
    runs = materialize(
        texts.select("text", F.explode(_grams(F.col("text"))).alias("gram")).join(
            sought.select("gram").distinct(), "gram", "left_semi"
        ),
        "grams",
    )
    counts = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = sought.join(counts, "gram").groupBy("needle").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram")
    )
    return (
        runs.join(rarest, "gram").filter(F.contains(F.col("text"), F.col("needle")))
        .select("text", "needle")
    )


def word_heads(rows: DataFrame, most: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """The first ``most`` rows of each distinct word (and group) of (obs_id, text, *groups)."""
    words = rows.select(
        *groups, "obs_id", F.explode(F.array_distinct(split_white(F.col("text")))).alias("text")
    ).filter(F.col("text") != "")
    return materialize(lowest_ids(words, [*groups, "text"], most), "words")


def lowest_ids_containing(
    rows: DataFrame, needles: DataFrame, most: int, groups: tuple[str, ...] = (),
    heads: DataFrame | None = None,
) -> DataFrame:
    """For each needle (and group) the first ``most`` rows whose ``text`` contains it.

    ``rows`` is (obs_id, text, *groups); needles hold no white space.  Many
    needles are matched against the distinct words of the texts instead of the
    texts: a needle without white space is in a text if and only if it is in one
    of its words, and only the first ``most`` rows of each word can matter.
    ``heads`` may hand in the ``word_heads`` of the rows.
    """
    keys = list(groups)
    few = _few(needles, FEW)
    if few is not None:
        hits = _test_each(rows, "text", few).select(*keys, "needle", "obs_id")
        return lowest_ids(hits, [*keys, "needle"], most)
    heads = word_heads(rows, most, groups) if heads is None else heads
    pairs = materialize(match_substrings(heads, needles), "pairs")
    # A word with ``most`` rows bounds the ids that can matter to every needle in it.
    full = heads.filter(F.col("position") == most - 1).select(
        *keys, "text", F.col("obs_id").alias("last_id")
    )
    bounds = full.join(pairs, "text").groupBy(*keys, "needle").agg(F.min("last_id").alias("last_id"))
    hits = heads.drop("position").join(pairs, "text")
    hits = hits.join(bounds, [*keys, "needle"], "left").filter(
        F.col("last_id").isNull() | (F.col("obs_id") <= F.col("last_id"))
    )
    return lowest_ids(
        hits.select(*keys, "needle", "obs_id").distinct(), [*keys, "needle"], most
    )


def has_many(needles: DataFrame) -> bool:
    return _few(needles, FEW) is None
