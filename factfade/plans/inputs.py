"""The given tables seen as a memory store.

Each document is an observation of its source, each conversation an event, each
row of the event stream a logged call.  The same views exist as DuckDB text in
``oracle_views.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.model import Memory
from factfade.session import configure

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them.

    As a pattern the path may name either; a plain path would have to be a folder.
    """
    return configure(spark).readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts spread over the cores.

    The small sample files have a single row group, which one task would read and
    tokenize alone.  Data that already comes in enough pieces stays as it is.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def later(text: str, unit: str, amount: Column) -> Column:
    return F.timestamp_add(unit, amount.cast("long"), moment(text))


def nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def source_id() -> Column:
    return F.substring("source", 4, 20).cast("long") + 1


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select(
        source_id().alias("id"),
        F.col("source").alias("name"),
    ).select(
        "id", "name",
        F.when(F.col("id") % 2 == 1, "feed").otherwise("corpus").alias("entity_type"),
        F.when(F.col("id") % 10 == 0, moment("2024-01-31 00:00:00")).alias("deleted_at"),
        moment("2023-01-01 00:00:00").alias("created_at"),
        later("2024-01-01 00:00:00", "HOUR", F.col("id")).alias("updated_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    fifth = F.col("conv_id") % 5
    return ids.select(
        (F.col("conv_id") + 1).alias("id"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("label"),
        F.concat(
            F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")
        ).alias("event_date"),
        F.when(F.col("conv_id") % 2 == 0, "chat").otherwise("review").alias("event_type"),
        nothing("string").alias("context"),
        F.when(fifth == 0, moment("2024-01-31 23:00:00"))
        .when(fifth == 1, moment("2024-03-01 00:00:00")).alias("expires_at"),
        later("2024-01-01 00:00:00", "MINUTE", F.col("conv_id")).alias("created_at"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return texts(spark, sf_dir, "documents").select(
        (d + 1).alias("id"),
        source_id().alias("entity_id"),
        F.col("text").alias("content"),
        F.when(d % 3 == 0, "user").when(d % 3 == 1, "inferred").otherwise("session").alias("source"),
        ((d % 11).cast("double") / 10.0).alias("confidence"),
        (d % 8).alias("access_count"),
        nothing("timestamp_ntz").alias("last_accessed"),
        F.when(d % 97 == 96, F.lit(999999999).cast("long"))
        .when(d % 4 == 0, d % 10 + 1).alias("event_id"),
        F.col("lang").alias("entity_type"),
        F.when(d % 17 == 16, moment("2024-01-15 00:00:00")).alias("deleted_at"),
        F.when(d % 23 == 22, d).alias("superseded_by"),
        nothing("timestamp_ntz").alias("superseded_at"),
        nothing("string").alias("superseded_reason"),
        nothing("long").alias("superseded_by_run"),
        later("2024-02-01 00:00:00", "DAY", -(d % 200)).alias("created_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as observations of three entities, one per role."""
    c, t = F.col("conv_id"), F.col("turn")
    return texts(spark, sf_dir, "conversations").select(
        (c * 100 + t + 1).alias("id"),
        F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)
        .otherwise(3).cast("long").alias("entity_id"),
        F.col("text").alias("content"),
        F.lit("user").alias("source"),
        F.lit(1.0).alias("confidence"),
        (t % 4).alias("access_count"),
        nothing("timestamp_ntz").alias("last_accessed"),
        (c + 1).alias("event_id"),
        F.lit("role").alias("entity_type"),
        nothing("timestamp_ntz").alias("deleted_at"),
        nothing("long").alias("superseded_by"),
        nothing("timestamp_ntz").alias("superseded_at"),
        nothing("string").alias("superseded_reason"),
        nothing("long").alias("superseded_by_run"),
        later("2024-01-01 00:00:00", "MINUTE", c * 10 + t).alias("created_at"),
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "conversations").select("role").distinct()
    return names.select(
        F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)
        .otherwise(3).cast("long").alias("id"),
        F.col("role").alias("name"),
        F.lit("role").alias("entity_type"),
        nothing("timestamp_ntz").alias("deleted_at"),
        moment("2023-01-01 00:00:00").alias("created_at"),
        moment("2023-01-01 00:00:00").alias("updated_at"),
    )


def langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("lang").distinct()
    return names.select(
        lang_id().alias("id"),
        F.col("lang").alias("name"),
        F.lit("language").alias("entity_type"),
        nothing("timestamp_ntz").alias("deleted_at"),
        moment("2023-01-01 00:00:00").alias("created_at"),
        moment("2023-01-01 00:00:00").alias("updated_at"),
    )


def lang_id() -> Column:
    lang = F.col("lang")
    return (
        F.when(lang == "en", 1).when(lang == "fr", 2).when(lang == "de", 3).otherwise(4).cast("long")
    )


def lang_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations of their language: real exact copies occur."""
    d = F.col("doc_id")
    return texts(spark, sf_dir, "documents").select(
        (d + 1).alias("id"),
        lang_id().alias("entity_id"),
        F.col("text").alias("content"),
        "source",
        F.lit(1.0).alias("confidence"),
        F.lit(0).cast("long").alias("access_count"),
        nothing("timestamp_ntz").alias("last_accessed"),
        nothing("long").alias("event_id"),
        F.lit("language").alias("entity_type"),
        nothing("timestamp_ntz").alias("deleted_at"),
        nothing("long").alias("superseded_by"),
        nothing("timestamp_ntz").alias("superseded_at"),
        nothing("string").alias("superseded_reason"),
        nothing("long").alias("superseded_by_run"),
        later("2024-02-01 00:00:00", "DAY", -(d % 60)).alias("created_at"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nodes(name: str, key: str, label: str, base: int, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            (F.col(key).cast("long") + base).alias("id"), F.col(label).alias("name"),
            F.lit(kind).alias("entity_type"), nothing("timestamp_ntz").alias("deleted_at"),
            moment("2023-01-01 00:00:00").alias("created_at"),
            moment("2023-01-01 00:00:00").alias("updated_at"),
        )

    return (
        nodes("region", "r_regionkey", "r_name", 1, "region")
        .unionByName(nodes("nation", "n_nationkey", "n_name", 100, "nation"))
        .unionByName(nodes("supplier", "s_suppkey", "s_name", 1000, "supplier"))
        .unionByName(nodes("customer", "c_custkey", "c_name", 10000000, "customer"))
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edges(name, key, base, to, to_base, kind) -> DataFrame:
        own = F.col(key).cast("long")
        start = own + (100 if name == "nation" else base)
        return table(spark, sf_dir, name).select(
            (own + base).alias("id"), start.alias("from_entity_id"),
            (F.col(to).cast("long") + to_base).alias("to_entity_id"),
            F.lit(kind).alias("relation_type"), nothing("string").alias("context"),
            moment("2023-01-01 00:00:00").alias("created_at"),
        )

    return (
        edges("nation", "n_nationkey", 1, "n_regionkey", 1, "part_of")
        .unionByName(edges("supplier", "s_suppkey", 1000, "s_nationkey", 100, "located_in"))
        .unionByName(edges("customer", "c_custkey", 10000000, "c_nationkey", 100, "located_in"))
    )


def memory(spark: SparkSession, sf_dir: str) -> Memory:
    """Documents by source, with events."""
    return Memory(
        entities=entities(spark, sf_dir), observations=observations(spark, sf_dir),
        events=events(spark, sf_dir), relations=no_relations(spark),
    )


def no_relations(spark: SparkSession) -> DataFrame:
    from factfade.schemas import TABLES

    return configure(spark).createDataFrame([], TABLES["relations"])


def turn_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """Conversation turns by role, grouped by event."""
    return Memory(
        entities=roles(spark, sf_dir), observations=turns(spark, sf_dir),
        events=events(spark, sf_dir), relations=no_relations(spark),
    )


def lang_memory(spark: SparkSession, sf_dir: str) -> Memory:
    from factfade.schemas import TABLES

    configure(spark)
    return Memory(
        entities=langs(spark, sf_dir), observations=lang_observations(spark, sf_dir),
        events=events(spark, sf_dir), relations=no_relations(spark),
        runs=spark.createDataFrame([], TABLES["runs"]),
        decisions=spark.createDataFrame([], TABLES["decisions"]),
        decision_sources=spark.createDataFrame([], TABLES["decision_sources"]),
    )


def graph_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """Regions, nations, suppliers and customers with their edges; no observations.

    Conversation turns hang on the three first regions.
    """
    return Memory(
        entities=graph_nodes(spark, sf_dir), observations=turns(spark, sf_dir),
        events=events(spark, sf_dir), relations=relations(spark, sf_dir),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight hand-written queries and one for every benchmark passage."""
    fixed = [
        (1, "src1", 10), (2, "the of", 20), (3, "feed", 5), (4, "conversation 6", 10),
        (5, "%", 5), (6, "   ", 5), (7, "the", 0), (8, "the of an", 66),
    ]
    written = configure(spark).createDataFrame(fixed, "query_id long, text string, max_results int")
    passages = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 100).alias("query_id"), "text",
        F.lit(20).alias("max_results"),
    )
    return written.unionByName(passages)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        (v + 1).alias("observation_id"), (F.col("label").cast("long") + 1).alias("entity_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("entity_name"),
        F.lit("local").alias("provider"), F.lit("http://localhost/v1").alias("endpoint_key"),
        F.lit("model-a").alias("model_id"), F.lit(64).alias("dimensions"), "embedding",
        (v % 2 == 1).alias("cached"),
        later("2024-02-01 00:00:00", "HOUR", -(v % 500)).alias("created_at"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(stream: DataFrame) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    return stream.select(
        (F.col("event_id") + 1).alias("id"), "ts",
        F.when(kind == "view", "recall").when(kind == "click", "remember")
        .when(kind == "purchase", "forget").when(kind == "signup", "remember_event")
        .otherwise("recall_entity").alias("tool"),
        F.concat(F.lit("client"), (user % 5).cast("string")).alias("client_name"),
        F.when(user % 2 == 0, "global").otherwise("project").alias("db_scope"),
        user.alias("entity_key"), F.col("value").alias("duration_ms"),
        F.col("props").alias("args_summary"),
        F.when(kind == "error", 1).otherwise(0).alias("is_error"),
        F.when(kind == "click", F.col("event_id") % 4).otherwise(F.lit(0)).alias("conflicts_surfaced"),
        F.when((kind == "click") & (F.col("event_id") % 37 == 0), 1).otherwise(0)
        .cast("long").alias("conflict_fts_query_errors"),
    )


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "view").select(
        (e + 1).alias("tool_call_id"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"),
        (e % 90 + 1).alias("fts_hits"), (e % 7).alias("fts_phrase_hits"),
        (e % 90 + 1).alias("candidates_total"),
        F.least(e % 90 + 1, F.lit(20)).alias("results_returned"),
        F.lit(20).cast("long").alias("limit_requested"),
        (F.col("value") / 1000.0).alias("score_min"), (F.col("value") / 500.0).alias("score_max"),
        F.when(e % 31 == 0, 1).otherwise(0).cast("long").alias("fts_query_errors"),
    )
    counted = F.map_from_arrays(
        F.array(F.lit("fts"), F.lit("fts_phrase")), F.array("fts_hits", "fts_phrase_hits")
    )
    return rows.withColumn("channels", F.map_filter(counted, lambda k, n: n > 0))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as incoming facts, a batch per conversation.

    A few carry an impossible confidence or hang on an event that has ended.
    """
    return facts_of(texts(spark, sf_dir, "conversations"))


def facts_of(conversations: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return conversations.select(
        c.alias("batch_id"), (c * 100 + t).alias("seq"),
        F.when(t % 2 == 0, F.col("role")).otherwise(F.upper("role")).alias("entity"),
        F.when(t % 3 == 0, "speaker").alias("entity_type"), F.col("text").alias("observation"),
        nothing("string").alias("source"),
        F.when((c * 100 + t) % 301 == 5, 1.5).otherwise(0.5).alias("confidence"),
        F.when(t == 0, c + 1).alias("event_id"),
    )
