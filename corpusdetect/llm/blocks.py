"""A query set against all rows, in blocks of both."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_values(items: DataFrame, id_col: str, value_col: str, keep: int) -> DataFrame:
    """(value, ids): every distinct value with its ``keep`` smallest distinct ids.

    With ties going to the smaller id, no more ids of a value can be among the ``keep`` best. Ranks
    are cut off within each task before the shuffle, so that a value that a third of the rows share
    is no large group.
    """
    by_value = Window.partitionBy(value_col).orderBy(id_col)
    return (
        items.select(id_col, value_col)
        .where(F.col(id_col).isNotNull())
        .withColumn("_rank", F.dense_rank().over(by_value))
        .where(F.col("_rank") <= keep)
        .groupBy(value_col)
        .agg(F.sort_array(F.collect_set(id_col)).alias("ids"))
        .withColumnRenamed(value_col, "value")
    )


def search_in_blocks(
    items: DataFrame,
    queries: DataFrame,
    search: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    n_items: int,
    n_queries: int,
    item_block: int,
    query_block: int,
) -> DataFrame:
    """``search`` over each pair of a block of items and a block of queries.

    ``items`` and ``queries`` have a column ``dim``: only rows of one dim meet. Blocks are dealt by
    hash, so they are of even size; a task holds one block of each kind.
    """
    item_blocks = max(1, math.ceil(n_items / item_block))
    query_blocks = max(1, math.ceil(n_queries / query_block))

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = items.withColumn("_i", F.pmod(F.xxhash64("value"), F.lit(item_blocks)).cast("int"))
    left = left.withColumn("_q", all_of(query_blocks))
    right = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    right = right.withColumn("_i", all_of(item_blocks))
    keys = ("dim", "_i", "_q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return search(a.slice(0, 0), b.slice(0, 0))
        return search(a, b)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def best(found: DataFrame, measure: str, descending: bool, k: int, id_col: str) -> DataFrame:
    """The k best of what the blocks found, ranked from 1; ties to the smaller id."""
    order = F.col(measure).desc() if descending else F.col(measure).asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
