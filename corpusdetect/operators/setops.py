"""Unions, deduplication and interleaving of sample tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sample_row_hash
from ..plans.joins import fits_broadcast
from ..plans.storage import materialize
from ..schemas import HUMAN

# Hashes of repeated rows sent to every executor.
REPEATED = 1_000_000


def concatenate(tables: Sequence[DataFrame], order_name: str = "src_ord") -> DataFrame:
    """Union of equally typed tables; ``order_name`` tells where a row came from."""
    kinds = [{f.name: f.dataType for f in t.schema} for t in tables]
    if any(kind != kinds[0] for kind in kinds):
        raise ValueError("the tables hold different kinds of samples")
    marked = [t.withColumn(order_name, F.lit(i)) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b), marked)


def concatenate_frames(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def combined_tag(tags: Sequence[str]) -> str:
    return "-".join(tags)


def first_wins(df: DataFrame, order: Sequence[Column], key: Column | None = None) -> DataFrame:
    """The first row, in ``order``, of every set of rows with the same sample hash.

    Of rows with equal order keys too, one stays. Only hashes and order keys are counted and shuffled;
    what comes out are the hashes that occur more than once. Up to REPEATED of these go to every executor, and
    rows are kept or dropped where they are read. Copies are reduced in each task, so no copy, however
    frequent, makes a hot key.
    """
    rows = df.select(
        F.struct("*").alias("row"),
        (sample_row_hash() if key is None else key).alias("key"),
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("place"),
    )
    at_place = rows.groupBy("key", "place").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("place", "n")).alias("first")
    sets = at_place.groupBy("key").agg(first, F.sum("n").alias("n")).where("n > 1")
    repeated = materialize(
        sets.select(F.col("key").alias("_key"), F.col("first.place").alias("_place"), F.col("first.n").alias("_ties")),
        "repeated",
    )
    small = F.broadcast(repeated) if fits_broadcast(repeated, REPEATED) else repeated
    met = rows.join(small, F.col("key").eqNullSafe(F.col("_key")), "left")
    kept = met.where(F.col("_ties").isNull() | F.col("place").eqNullSafe(F.col("_place")))
    if repeated.where("_ties > 1").isEmpty():
        return kept.select("row.*")
    tied = kept.where("_ties > 1").dropDuplicates(["key"])
    return kept.where("_ties IS NULL OR _ties = 1").select("row.*").union(tied.select("row.*"))


def interlace(samples: DataFrame, key: str, generators: Sequence[str]) -> DataFrame:
    """Order of the combined store: each human row, then its generated rows.

    ``key`` identifies the source sample; generated rows follow in the order of
    ``generators``. Adds ``gen_ord`` and sorts by (key, gen_ord). The rows are written first, as a
    global sort samples its input and would compute it twice.
    """
    tags = F.array(F.lit(HUMAN), *[F.lit(g) for g in generators])
    placed = samples.withColumn("gen_ord", F.array_position(tags, F.col("Generator")) - 1)
    return materialize(placed, "interlaced").orderBy(key, "gen_ord")
