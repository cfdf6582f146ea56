"""Numbering and looking back over rows without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.session import materialize

# monotonically_increasing_id counts the rows of a partition in its lower bits.
_PLACE_BITS = 33


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Dense numbers 1..n in the given total order.

    Rows are range-partitioned, sorted and written once with their place in the partition;
    each is then moved up by the sizes of the partitions before it.  Rows are dealt a
    single time, and only one count per partition meets in one task.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    before = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_before"),
        )
    )
    inside = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + inside)
        .drop("_part", "_before", "_place")
    )


def with_previous(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    value: Column,
    name: str = "previous",
) -> DataFrame:
    """The last non-NULL ``value`` among strictly earlier rows of the same keys.

    ``bucket`` cuts the order into slices (it must grow with it).  Windows run
    inside one slice of one key; only the last value of each slice is carried
    over to the later ones, so a key with a third of all rows is many tasks.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    moment = F.struct(*[F.col(c) for c in order])
    carried = (
        rows.filter(F.col("_value").isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.max_by("_value", moment).alias("_last"))
    )
    # Every slice that has rows needs the value of the nearest slice before it.
    slices = rows.select(*keys, "_bucket").distinct().join(carried, [*keys, "_bucket"], "left")
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = slices.select(
        *keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(slices, [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_bucket", "_value", "_inside", "_carried")
    )
