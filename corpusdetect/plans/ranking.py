"""Order-based computations without one task per group or per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def range_buckets(df: DataFrame, keys: Sequence[str], value: str, name: str = "_bucket") -> DataFrame:
    """Cut every group into runs of consecutive values.

    Rows are range-partitioned on (keys, value); the partition number is the
    bucket. Rows of one group with equal values share a bucket, buckets of a
    group are ordered as its values are, and a group that holds most of the
    rows is spread over most of the partitions.
    """
    order = [F.col(k) for k in keys] + [F.col(value)]
    return df.repartitionByRange(*order).withColumn(name, F.spark_partition_id())


def global_index(
    df: DataFrame, order: Sequence[Column], name: str = "index", total: str | None = None
) -> DataFrame:
    """Consecutive numbers from 0 in the total order ``order``.

    ``total`` names a further column for the number of all rows.

    The rows are range-partitioned, sorted there and written with their place in the partition, in one
    shuffle; each range is then shifted by the number of rows before it. ``order`` must be total for a
    repeatable result. No window spans the table: the widest one covers one row per partition.
    """
    ranged = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()),
        "ordered",
    )
    # Spark numbers rows by partition in the upper bits and by place in the lower 33.
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(Window.partitionBy()).alias("_total"),
        )
    )
    # One row per partition of the range shuffle: bounded by its partition count.
    numbered = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_part", "_place", "_offset")
    )
    return numbered.withColumnRenamed("_total", total) if total else numbered.drop("_total")
