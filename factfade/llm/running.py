"""Sums over earlier rows of a key, without a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.session import materialize


def running_before(
    df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str]
) -> DataFrame:
    """Adds, for each ``new: old`` of ``values``, the sum of ``old`` over earlier rows.

    Rows are range-partitioned by keys and order and written with the partition they
    fell into; sums run inside one partition of one key, and one row per partition
    and key carries on what came before.  Keys must not be NULL.  ``order`` should be
    total; rows that tie are summed in any one order.
    """
    placed = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id()),
        "running",
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(
        *[F.sum(old).alias(f"_sum_{new}") for new, old in values.items()]
    )
    parts = parts.select(
        *keys, "_part",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_all_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = placed.select(
        "*",
        *[F.coalesce(F.sum(old).over(inside), F.lit(0)).alias(f"_in_{new}") for new, old in values.items()],
    )
    joined = summed.join(parts, [*keys, "_part"])
    for new in values:
        joined = joined.withColumn(new, F.col(f"_all_{new}") + F.col(f"_in_{new}"))
    return joined.drop("_part", *[f"_all_{n}" for n in values], *[f"_in_{n}" for n in values])
