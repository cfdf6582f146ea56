"""Accesses, removals and supersessions as appended marks; same results as in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.operators import cleanup
from factfade.operators.marks import Marks
from factfade.plans import cleaning, inputs, recall, writing  # noqa: F401  their SQL is shared
from factfade.plans.inputs import AS_OF
from factfade.plans.registry import ORACLES, query
from factfade.plans.similar import _cache
from factfade.session import scratch_path


def _marks(spark: SparkSession) -> Marks:
    return Marks.create(spark, scratch_path(spark, "marks"))


@query("touch_marked", ORACLES["touch"])
def touch_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem, marks = inputs.memory(spark, sf_dir), _marks(spark)
    d = inputs.table(spark, sf_dir, "documents")
    for batch, ids in enumerate((F.col("doc_id") + 1, F.floor(F.col("doc_id") / 2) + 1), 1):
        marks.touch(mem, d.select(ids.alias("id")), AS_OF, batch)
    return marks.observations(mem.observations).select("id", "access_count", "last_accessed")


@query("forget_observations_marked", ORACLES["forget_observations"])
def forget_observations_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = inputs.memory(spark, sf_dir).with_tables(embeddings=_cache(spark, sf_dir))
    marks = _marks(spark)
    ids = inputs.table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("id"))
    result = marks.forget_observations(mem, ids, AS_OF, 1)
    after = marks.memory(mem)
    return (
        result.select(F.lit("asked").alias("part"), "id", "deleted")
        .unionByName(after.observations.select(
            F.lit("row").alias("part"), "id", F.col("deleted_at").isNotNull().alias("deleted")))
        .unionByName(after.embeddings.select(
            F.lit("vector").alias("part"), F.col("observation_id").alias("id"),
            F.lit(False).alias("deleted")))
    )


@query("apply_duplicates_marked", ORACLES["apply_duplicates"])
def apply_duplicates_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem, marks = inputs.lang_memory(spark, sf_dir), _marks(spark)
    marks.supersede(cleanup.apply_duplicates(mem, AS_OF), AS_OF, 1)
    return marks.observations(mem.observations).select(
        "id", "superseded_by", "superseded_at", "superseded_reason", "superseded_by_run"
    )
