"""Bringing outside data into the fixed table shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.functions.scoring import HALF_LIFE_GLOBAL, HALF_LIFE_PROJECT
from factfade.schemas import (
    BACKFILLED,
    COLUMN_DEFAULTS,
    LOG_VERSIONS,
    MEMORY_VERSIONS,
    table_schema,
)
from factfade.session import at

FACT = "entity string, entity_type string, observation string, source string, confidence double, event_id long"


def conform_schema(df: DataFrame, table: str, as_of) -> DataFrame:
    """An older table in the present shape.

    Missing columns come in with their default or NULL; empty creation and change
    times of entities become the time of the upgrade.
    """
    columns = []
    for field in table_schema(table).fields:
        default = F.lit(COLUMN_DEFAULTS.get((table, field.name)))
        c = F.col(field.name) if field.name in df.columns else default
        if (table, field.name) in BACKFILLED:
            c = F.coalesce(c, at(as_of))
        columns.append(c.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def stamp_versions(stamps: DataFrame, as_of, log: bool = False) -> DataFrame:
    """Schema versions after an upgrade: each is stamped once and keeps its first time."""
    last = LOG_VERSIONS if log else MEMORY_VERSIONS
    versions = stamps.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("version"))
    new = versions.join(stamps, "version", "left_anti").withColumn("applied_at", at(as_of))
    return stamps.select("version", "applied_at").unionByName(new)


def decision_sources(decisions: DataFrame) -> DataFrame:
    """Source ids that an older decision table keeps as a JSON array, one per row."""
    ids = F.from_json("source_obs_ids", "array<bigint>")
    return decisions.select(
        F.col("id").alias("decision_id"), F.explode(ids).alias("source_obs_id")
    )


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, ``..`` resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = path.startswith("/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            p != "..", F.concat(done, F.array(p))
        ).when(
            (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1))) != ".."),
            F.slice(done, 1, F.size(done) - 1),
        ).when(rooted, done).otherwise(F.concat(done, F.array(p))),
    )
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(walked, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def route_scope(df: DataFrame, home: str, project: str = "project") -> DataFrame:
    """Scope and half-life of each row from its project text.

    Empty is the global scope; absolute paths stand as they are; ``~``, ``~/x``
    and relative paths are taken from ``home``.
    """
    p = F.col(project)
    below = F.when(p.rlike(r"^~[/\\]"), F.regexp_replace(p, r"^..", "")).otherwise(p)
    path = (
        F.when(p.startswith("/"), p)
        .when(p == "~", F.lit(home))
        .otherwise(clean_path(F.concat(F.lit(home.rstrip("/") + "/"), below)))
    )
    is_global = F.coalesce(p == "", F.lit(True))
    return df.withColumn("scope", F.when(is_global, "global").otherwise(path)).withColumn(
        "half_life", F.when(is_global, HALF_LIFE_GLOBAL).otherwise(HALF_LIFE_PROJECT)
    )


def parse_facts(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """Facts from JSON text, one object or an array of them per row.

    Returns the facts with their place in the array and the rows that are no such
    JSON.  Other columns of ``df`` are kept.
    """
    # Types are checked on the variant: a number is no entity name.
    value = F.try_parse_json(json_col)
    listed = F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.when(F.schema_of_variant(value).startswith("OBJECT"), F.array(value)),
    )
    rows = df.withColumn("_listed", listed)
    texts = ("entity", "entity_type", "observation", "source")
    numbers = {"confidence": "double", "event_id": "bigint"}

    def raw(name: str) -> Column:
        return F.try_variant_get(F.col("_fact"), f"$.{name}", "variant")

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(raw(name)), F.lit("VOID"))

    wrong = F.lit(False)
    for name in texts:
        wrong = wrong | ~kind(name).isin("STRING", "VOID")
    for name in numbers:
        wrong = wrong | kind(name).isin("STRING", "BOOLEAN") | kind(name).rlike("^(ARRAY|OBJECT)")
    wrong = wrong | ~F.schema_of_variant("_fact").startswith("OBJECT")
    facts = rows.filter(F.col("_listed").isNotNull()).select(
        *[c for c in df.columns], F.posexplode("_listed").alias("fact_no", "_fact")
    ).withColumn("_wrong", wrong)
    good = facts.filter(~F.col("_wrong")).select(
        *df.columns, "fact_no",
        *[F.try_variant_get(F.col("_fact"), f"$.{n}", "string").alias(n) for n in texts],
        *[F.try_variant_get(F.col("_fact"), f"$.{n}", t).alias(n) for n, t in numbers.items()],
    )
    bad = (
        rows.filter(F.col("_listed").isNull()).select(*df.columns, F.lit(None).cast("int").alias("fact_no"))
        .unionByName(facts.filter("_wrong").select(*df.columns, "fact_no"))
    )
    return good, bad
