"""Analytics over the usage log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.functions.privacy import sanitize_args as _args
from factfade.functions.privacy import summarize_result as _result
from factfade.operators.ordering import with_previous

TOP = 20


def mean_ms() -> Column:
    """Mean duration to one decimal, summed exactly so that no order of rows changes it."""
    return F.round(F.avg(F.col("duration_ms").cast("decimal(18,6)")), 1).cast("double")


def sanitize_args(calls: DataFrame, column: str, strict: bool = False) -> DataFrame:
    return calls.withColumn("args_summary", _args(F.col(column), strict))


def summarize_results(calls: DataFrame, column: str) -> DataFrame:
    return calls.withColumn("result_summary", _result(F.col(column)))


def usage_by_client(calls: DataFrame) -> DataFrame:
    """Calls and mean duration by client and tool, most calls first."""
    return (
        calls.groupBy("client_name", "tool")
        .agg(F.count(F.lit(1)).alias("calls"), mean_ms().alias("avg_ms"))
        .orderBy(F.desc("calls"), "client_name", "tool")
    )


def ranking_quality(metrics: DataFrame) -> DataFrame:
    """Searches with the most candidates."""
    return (
        metrics.orderBy(F.desc("candidates_total"), "tool_call_id").limit(TOP)
        .select(
            "tool_call_id", "query", "candidates_total", "results_returned",
            F.round("score_min", 3).alias("score_min"), F.round("score_max", 3).alias("score_max"),
            "fts_query_errors", "channels",
        )
    )


def degraded_searches(calls: DataFrame, metrics: DataFrame) -> DataFrame:
    """Searches and hint look-ups whose text search failed over, newest first."""
    searches = (
        metrics.filter(F.col("fts_query_errors") > 0)
        .join(calls.select(F.col("id").alias("tool_call_id"), "ts", "tool"), "tool_call_id")
        .select("tool_call_id", "ts", "tool", "query", F.col("fts_query_errors").alias("errors"))
    )
    hints = calls.filter(F.col("conflict_fts_query_errors") > 0).select(
        F.col("id").alias("tool_call_id"), "ts", "tool", F.lit(None).cast("string").alias("query"),
        F.col("conflict_fts_query_errors").alias("errors"),
    )
    return searches.unionByName(hints).orderBy(F.desc("ts"), "tool_call_id")


def overfetch(metrics: DataFrame) -> DataFrame:
    """Searches that returned the smallest part of their candidates."""
    share = F.round(F.col("results_returned") / F.col("candidates_total"), 2)
    return (
        metrics.filter(F.col("candidates_total") > 0)
        .select(
            "tool_call_id", "query", "candidates_total", "results_returned", "limit_requested",
            share.alias("yield_ratio"),
        )
        .orderBy("yield_ratio", "tool_call_id").limit(TOP)
    )


def error_rate(calls: DataFrame) -> DataFrame:
    return (
        calls.groupBy("tool")
        .agg(
            F.count(F.lit(1)).alias("total"), F.sum(F.col("is_error").cast("long")).alias("errors")
        )
        .withColumn("error_pct", F.round(100.0 * F.col("errors") / F.col("total"), 1))
        .orderBy(F.desc("error_pct"), "tool")
    )


def channel_effectiveness(metrics: DataFrame) -> DataFrame:
    """How often each channel appears."""
    return (
        metrics.select(F.explode(F.map_keys("channels")).alias("channel"))
        .groupBy("channel").agg(F.count(F.lit(1)).alias("appearances"))
        .orderBy(F.desc("appearances"), "channel")
    )


def hint_action_ratio(
    calls: DataFrame, window_seconds: int = 3600, link: str = "entity_key"
) -> DataFrame:
    """Writes that surfaced hints and those followed by a ``forget`` within the window.

    Time is cut into slices as long as the window.  A forget after the hint is
    either in its slice, where the latest one decides, or in the next, where the
    first one does, so rows only meet one pre-aggregated row per slice and no
    pairs are formed.  ``link`` is what both calls share: an entity, or a surfaced
    observation id where the log carries one.
    """
    micros = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")
    )
    width = window_seconds * 1_000_000
    slice_no = F.floor(micros / F.lit(width)).cast("long")
    timed = calls.withColumn("at", micros).withColumn("slice", slice_no)
    forgets = timed.filter(F.col("tool") == "forget").groupBy(F.col(link).alias("_link"), "slice").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    same = forgets.select("_link", "slice", "last_at")
    following = forgets.select("_link", (F.col("slice") - 1).alias("slice"), "first_at")
    hints = timed.filter(
        F.col("tool").isin("remember") & (F.col("conflicts_surfaced") > 0)
    ).withColumn("_link", F.col(link))
    acted = (F.coalesce(F.col("last_at") > F.col("at"), F.lit(False))) | (
        F.coalesce(F.col("first_at") <= F.col("at") + width, F.lit(False))
    )
    return (
        hints.join(same, ["_link", "slice"], "left").join(following, ["_link", "slice"], "left")
        .groupBy("db_scope")
        .agg(
            F.count(F.lit(1)).alias("calls_with_hints"),
            F.sum("conflicts_surfaced").alias("hints_surfaced"),
            F.count_if(acted).alias("acted_on"),
        )
        .withColumn("ratio", F.col("acted_on") / F.col("calls_with_hints"))
        .orderBy("db_scope")
    )


def entity_transitions(
    calls: DataFrame, days: int = 7, link: str = "entity_key", slice_seconds: int = 3600
) -> DataFrame:
    """Consecutive writes on one entity at most ``days`` apart, by kind."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    writes = calls.filter(F.col("tool").isin("remember", "forget")).select(
        F.col(link).alias("link"), "ts", "id", "tool"
    )
    slice_no = F.floor(
        F.timestamp_diff("SECOND", origin, F.col("ts")) / F.lit(slice_seconds)
    ).cast("long")
    chained = with_previous(
        writes, ["link"], slice_no, ["ts", "id"], F.struct("ts", "tool")
    ).filter(F.col("previous").isNotNull())
    gap = F.timestamp_diff("MICROSECOND", F.col("previous.ts"), F.col("ts"))
    step = F.concat_ws("->", F.col("previous.tool"), F.col("tool"))
    kind = (
        F.when(step == "remember->remember", "silent_overwrite")
        .when(step == "remember->forget", "forget_correction")
        .when(step == "forget->remember", "post_forget_rewrite")
    )
    return (
        chained.filter(gap <= days * 86400 * 1_000_000)
        .select(kind.alias("transition")).filter(F.col("transition").isNotNull())
        .groupBy("transition").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("transition")
    )
