"""Usage counts per time bucket on the arriving log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.operators.usage import mean_ms

LATENESS = "10 minutes"


def usage_stream(calls: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Calls, mean duration and errors per bucket, client and tool.

    A bucket is final once the watermark has passed its end.
    """
    window = F.window("ts", bucket)
    return (
        # Watermarks need the zoned type; the session zone is UTC.
        calls.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", LATENESS)
        .groupBy(window.alias("bucket"), "client_name", "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"), mean_ms().alias("avg_ms"),
            F.sum(F.col("is_error").cast("long")).alias("errors"),
        )
        .select(
            F.col("bucket.start").alias("bucket_start"), "client_name", "tool", "calls", "avg_ms",
            "errors",
            F.round(100.0 * F.col("errors") / F.col("calls"), 1).alias("error_pct"),
        )
    )
