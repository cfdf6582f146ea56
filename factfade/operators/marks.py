"""Accesses, removals and supersessions as appended marks.

A read that counts accesses, a forget and an applied clean-up change few rows of a
large table.  ``Marks`` writes only these few, one folder per table and batch on shared
storage, and sums them up by id when the rows are read.  A batch that is written again
replaces its folder and sees the marks of earlier batches only, so a repeated job leaves
the same state.  Batches are numbered from 1 in the order in which they count.

Now and then write ``memory(mem)`` out as plain tables and go on with a new folder.
Undoing a clean-up run works on such plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.model import Memory, Write
from factfade.operators.search import counted_accesses
from factfade.operators.writes import forgotten_rows
from factfade.session import at

_TABLES = {
    "accesses": "id long, times long, at timestamp_ntz",
    "removals": "id long, is_row boolean, is_vector boolean, at timestamp_ntz",
    "supersessions": "id long, target long, run long, reason string, at timestamp_ntz",
}


class Marks:
    """The marks of one scope at a path all executors can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "Marks":
        """A folder without marks."""
        marks = cls(spark, path)
        for table, schema in _TABLES.items():
            marks._put(spark.createDataFrame([], schema), table, 0)
        return marks

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """Marks of one table with their batch; those of batches ``before`` one if given."""
        found = self.spark.read.schema(f"{_TABLES[name]}, batch long").parquet(f"{self.path}/{name}")
        return found if before is None else found.filter(F.col("batch") < before)

    # Reading

    def observations(self, observations: DataFrame, before: int | None = None) -> DataFrame:
        """``observations`` as the marks leave them, with the same columns.

        Marks are reduced to one row per id first.  The first removal counts, the last
        supersession, the time of the last access and the sum of all accesses.
        """
        last = lambda column: F.max_by(column, "batch")
        seen = self.table("accesses", before).groupBy("id").agg(
            F.sum("times").alias("_times"), last("at").alias("_seen_at")
        )
        gone = self.table("removals", before).filter("is_row").groupBy("id").agg(
            F.min_by("at", "batch").alias("_gone_at")
        )
        replaced = self.table("supersessions", before).groupBy("id").agg(
            last("target").alias("_target"), last("run").alias("_run"),
            last("reason").alias("_reason"), last("at").alias("_replaced_at"),
        )
        hit = F.col("_target").isNotNull()
        values = {
            "access_count": F.col("access_count") + F.coalesce("_times", F.lit(0)),
            "last_accessed": F.coalesce("_seen_at", "last_accessed"),
            "deleted_at": F.coalesce("deleted_at", "_gone_at"),
            "superseded_by": F.coalesce("_target", "superseded_by"),
            "superseded_at": F.coalesce("_replaced_at", "superseded_at"),
            "superseded_reason": F.when(hit, F.col("_reason")).otherwise(F.col("superseded_reason")),
            "superseded_by_run": F.when(hit, F.col("_run")).otherwise(F.col("superseded_by_run")),
        }
        kinds = {field.name: field.dataType for field in observations.schema}
        # One row per marked id: the observations meet all marks in a single join.
        marks = seen.join(gone, "id", "full_outer").join(replaced, "id", "full_outer")
        return observations.join(marks, "id", "left").select(
            *[values[c].cast(kinds[c]).alias(c) if c in values else F.col(c) for c in observations.columns]
        )

    def memory(self, mem: Memory, before: int | None = None) -> Memory:
        """``mem`` as the marks leave it."""
        tables = {"observations": self.observations(mem.observations, before)}
        if mem.embeddings is not None:
            gone = self.table("removals", before).filter("is_vector")
            tables["embeddings"] = mem.embeddings.join(
                gone.select(F.col("id").alias("observation_id")), "observation_id", "left_anti"
            ).select(*mem.embeddings.columns)
        return mem.with_tables(**tables)

    # Writing.  ``mem`` holds the plain tables, without the marks.

    def touch(self, mem: Memory, returned: DataFrame, as_of, batch: int) -> None:
        """As ``search.touch``: one mark per visible row that was returned."""
        now = self.memory(mem, batch)
        marks = counted_accesses(now, returned, as_of)
        self._put(marks.select("id", F.col("_times").alias("times"), at(as_of).alias("at")), "accesses", batch)

    def forget_observations(self, mem: Memory, ids: DataFrame, as_of, batch: int) -> DataFrame:
        """As ``writes.forget_observations``: one mark per row or vector; (id, deleted)."""
        now = self.memory(mem, batch)
        ids = ids.select("id").distinct()
        rows = forgotten_rows(now, ids).withColumn("is_row", F.lit(True))
        # Answers are written first, so that they and the marks are computed once.
        answers = ids.join(rows, "id", "left")
        vector = F.lit(False)
        if now.embeddings is not None:
            vectors = now.embeddings.select(
                F.col("observation_id").alias("id"), F.lit(True).alias("_vector")
            ).distinct()
            answers = answers.join(vectors, "id", "left")
            vector = F.coalesce("_vector", F.lit(False))
        answers = answers.select(
            "id", F.coalesce("is_row", F.lit(False)).alias("is_row"), vector.alias("is_vector"),
            F.coalesce("owner_live", F.lit(False)).alias("deleted"),
        )
        self._put(answers, "answers", batch)
        kept = self.spark.read.schema(answers.schema).parquet(f"{self.path}/answers/batch={batch}")
        self._put(
            kept.filter("is_row OR is_vector").select("id", "is_row", "is_vector", at(as_of).alias("at")),
            "removals", batch,
        )
        return kept.select("id", "deleted")

    def supersede(self, write: Write, as_of, batch: int) -> None:
        """The rows that ``cleanup.apply_duplicates`` superseded, from its audit trail."""
        decisions = write.appended["decisions"].select(
            F.col("id").alias("decision_id"), F.col("target_obs_id").alias("target"),
            F.col("run_id").alias("run"), F.col("rationale").alias("reason"),
        )
        marks = write.appended["decision_sources"].join(decisions, "decision_id").select(
            F.col("source_obs_id").alias("id"), "target", "run", "reason", at(as_of).alias("at")
        )
        self._put(marks, "supersessions", batch)
