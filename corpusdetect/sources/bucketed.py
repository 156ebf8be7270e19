"""Stores laid out by the hash that resumed and deduplicating jobs look rows up by."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedStore:
    """A table whose rows lie in buckets by the hash of a key column.

    A join on the key shuffles the other side only, into as many parts as there are buckets, whatever
    the size of the store. ``name`` is the table's name in the session's catalog, its files lie at ``path``.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.key, self.buckets = spark, name, path, key, buckets

    def append(self, rows: DataFrame) -> None:
        """Add rows; each bucket gets one file from a write."""
        dealt = rows.repartition(self.buckets, self.key)
        (
            dealt.write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, rows: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
        """The rows that the store does not hold, compared by ``on`` (the key, and further columns).

        Nulls are equal. All rows whose key is null meet one bucket, so a key should be a hash.
        """
        if not self.exists():
            return rows
        on = list(on or [self.key])
        if self.key not in on:
            raise ValueError(f"{on} lacks the store's key {self.key!r}")
        # The key is joined by plain equality: buckets are of no use to a null-safe one.
        stored = self.read().select(*[F.col(c).alias(f"_stored_{c}") for c in on]).hint("merge")
        same = [F.col(c).eqNullSafe(F.col(f"_stored_{c}")) for c in on if c != self.key]
        return rows.join(stored, reduce(and_, same, F.col(self.key) == F.col(f"_stored_{self.key}")), "left_anti")

    def add_missing(self, rows: DataFrame, on: Sequence[str] | None = None) -> None:
        """Append what is not stored, each key once."""
        on = list(on or [self.key])
        self.append(self.missing(rows.dropDuplicates(on), on))

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
