"""Size groups, running numbers and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import fits_broadcast, lookup_join
from ..plans.ranking import global_index, range_buckets
from ..plans.storage import materialize

# Different lengths that are folded in one row.
FOLD_LENGTHS = 4_096


def size_groups(df: DataFrame, length: str, max_diff: int | float, fold_up_to: int = FOLD_LENGTHS) -> DataFrame:
    """Number the greedy groups of similar length, from the shortest on.

    A group starts at its shortest member and ends before the first row that
    is more than ``max_diff`` longer: an int is a number of tokens, a float a
    share of the longer row. Adds ``size_group``, null where the length is null.

    Group borders depend only on which lengths occur, not on how often. Up to ``fold_up_to`` different
    lengths are folded in one row; of more, each gets a pointer to the border after it, and pointers
    are doubled until the borders that the shortest length leads to are all found.
    """
    lengths = materialize(df.select(F.col(length).cast("int").alias("n")).where("n IS NOT NULL").distinct(), "lengths")
    if fits_broadcast(lengths, fold_up_to):
        borders = _folded_borders(lengths, max_diff)
    else:
        borders = _doubled_borders(lengths, max_diff)
    numbered = global_index(borders, [F.col("first")], "size_group")
    # A group covers every length up to the next group's first one.
    after = numbered.select((F.col("size_group") - 1).alias("size_group"), F.col("first").alias("until"))
    longest = lengths.agg(F.max("n")).first()[0]
    until = F.coalesce(F.col("until") - 1, F.lit(longest))
    groups = numbered.join(after, "size_group", "left").select(
        F.col("size_group").cast("int").alias("size_group"), F.explode(F.sequence(F.col("first"), until)).alias("_length")
    )
    keyed = df.withColumn("_length", F.col(length).cast("int"))
    return lookup_join(keyed, groups, ["_length"], "left").drop("_length")


def _too_long(n: Column, anchor: Column, max_diff: int | float) -> Column:
    """Whether a row of length ``n`` opens a new group after one that ``anchor`` has opened."""
    tolerated = F.lit(max_diff)
    return n - anchor > (n * tolerated if isinstance(max_diff, float) else tolerated)


def _folded_borders(lengths: DataFrame, max_diff: int | float) -> DataFrame:
    """(first): where groups begin, of few lengths."""

    def step(state: Column, n: Column) -> Column:
        opens = state["anchor"].isNull() | _too_long(n, state["anchor"], max_diff)
        return F.struct(
            F.when(opens, n).otherwise(state["anchor"]).alias("anchor"),
            F.when(opens, F.concat(state["anchors"], F.array(n)))
            .otherwise(state["anchors"])
            .alias("anchors"),
        )

    start = F.struct(
        F.lit(None).cast("int").alias("anchor"), F.array().cast("array<int>").alias("anchors")
    )
    return lengths.agg(F.sort_array(F.collect_list("n")).alias("ns")).select(
        F.explode(F.aggregate("ns", start, step, lambda state: state["anchors"])).alias("first")
    )


def _next_borders(lengths: DataFrame, max_diff: int | float) -> DataFrame:
    """(n, next): for each length the first one too long for its group, null where there is none.

    What is too long stays so with more length, so the least whole number that is too long is searched
    around its estimate; the first length from there on follows in the order of both, range by range.
    """
    n = F.col("n").cast("bigint")
    if isinstance(max_diff, float):
        if max_diff >= 1:
            return lengths.select("n", F.lit(None).cast("int").alias("next"))
        around = F.floor(n / F.lit(1.0 - max_diff))
    else:
        around = n + max_diff
    tries = [F.when(_too_long(around + i, n, max_diff), around + i) for i in range(-2, 4)]
    asked = lengths.select("n", F.greatest(F.coalesce(*tries), n + 1).alias("at"))
    there = lengths.select(F.lit(None).cast("int").alias("n"), n.alias("at"))
    spread = materialize(range_buckets(asked.union(there), [], "at"), "ranges")
    following = F.min(F.when(F.col("n").isNull(), F.col("at")))
    # Read from the end, as a frame that only grows is summed up once.
    within = following.over(Window.partitionBy("_bucket").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0))
    # One row per range: the least length of all later ranges.
    least = spread.where("n IS NULL").groupBy("_bucket").agg(F.min("at").alias("least"))
    buckets = spread.select("_bucket").distinct().join(least, "_bucket", "left")
    later = F.min("least").over(Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
    heads = buckets.select("_bucket", later.alias("later"))
    found = spread.withColumn("within", within).where("n IS NOT NULL").join(F.broadcast(heads), "_bucket")
    return found.select("n", F.coalesce("within", "later").cast("int").alias("next"))


def _doubled_borders(lengths: DataFrame, max_diff: int | float) -> DataFrame:
    """(first): where groups begin, of any number of lengths: what the shortest leads to, in log steps."""
    jumps = materialize(_next_borders(lengths, max_diff).where("next IS NOT NULL"), "jumps")
    borders = materialize(lengths.agg(F.min("n").alias("first")).where("first IS NOT NULL"), "borders")
    while True:
        # With jumps of 2 ** i borders, twice as many are known as before.
        found = borders.join(jumps, F.col("first") == F.col("n")).select(F.col("next").alias("first"))
        if found.isEmpty():
            return borders
        borders = materialize(borders.union(found), "borders")
        far = jumps.alias("a").join(jumps.alias("b"), F.expr("a.next = b.n")).select("a.n", "b.next")
        jumps = materialize(far, "jumps")


def running_index(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """Number the rows from 0 in a total order."""
    return global_index(df, order, name)


def pages(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Cut the ordered rows into batches of ``size``; ``final`` marks the last.

    A batch is final when it could not be filled, so a table whose length is a
    multiple of ``size`` ends with a full batch that is the last one too.
    """
    page = lambda row: F.floor(row / F.lit(size)).cast("bigint")
    return (
        global_index(df, order, "_index", total="_total")
        .withColumn("batch_id", page(F.col("_index")))
        .withColumn("final", F.col("batch_id") == page(F.col("_total") - 1))
        .drop("_index", "_total")
    )
