"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on.  All are public Spark SQL options; the
# shuffle width and the broadcast threshold stay the cluster's own choice.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A batch for Python ends by size as well as by rows: rows may hold long texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    # Of a key that a JSON object repeats, the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


ROW_GROUP_BYTES = 16 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Set UTC and adaptive execution (skewed join sides are split at run time)."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen for a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="factfade-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/factfade-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several consumers or the next round of an
    iteration: it is computed once, survives the loss of executors, and the
    files give the optimizer true sizes for its join choices.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # A writer holds a row group in memory, whole texts included.
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at(as_of) -> "F.Column":
    """``as_of`` (text or datetime, UTC) as a zone-free timestamp literal."""
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")
