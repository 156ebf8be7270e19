"""Users' sources as Spark data sources, read in batch and as streams.

A source tells how far its data reach now and reads any stretch of positions; Spark does the rest:
partitions are read by tasks, repeated where one is lost, and a stream goes on at the position that its
checkpoint holds.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import SAMPLE_SCHEMA


class PositionedSource(ABC):
    """Rows at positions 0, 1, …; a new one is made from its options wherever it is needed.

    ``tag`` is the format's name, ``row_schema`` the schema of its rows. Rows at a position never change.
    """

    tag: str
    row_schema: T.StructType = SAMPLE_SCHEMA
    # Positions read by one task, and by one batch of a stream.
    stretch: int = 10_000
    batch: int = 1_000_000

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def reach(self) -> int:
        """How many positions there are now."""

    @abstractmethod
    def read(self, start: int, end: int) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        """The rows at positions ``start`` to ``end`` (exclusive), in the order of the schema.

        Spark gathers thousands of tuples before it hands them on. Where rows are large, give Arrow batches with the
        schema's columns: each goes on as it is, so a task holds no more than one of them.
        """


class Stretch(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))


def _stretches(start: int, end: int, size: int) -> list[Stretch]:
    return [Stretch(at, min(at + size, end)) for at in range(start, end, size)]


class _Reader(DataSourceReader):
    def __init__(self, source: PositionedSource):
        self.source = source

    def partitions(self) -> list[Stretch]:
        # A source without rows still has one, empty, partition.
        return _stretches(0, self.source.reach(), self.source.stretch) or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        return self.source.read(*partition.value)


class _StreamReader(DataSourceStreamReader):
    """Batches of positions; what comes while a batch runs is left to the next one."""

    def __init__(self, source: PositionedSource):
        self.source = source
        self.told: int | None = None

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        reach = self.source.reach()
        if self.told is not None:
            reach = min(reach, self.told + self.source.batch)
        self.told = reach
        return {"position": reach}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return _stretches(start["position"], end["position"], self.source.stretch)

    def read(self, partition: Stretch) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        return self.source.read(*partition.value)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the position; the source keeps nothing."""


def data_source(kind: type[PositionedSource]) -> type[DataSource]:
    """The Spark data source of a kind of positioned source."""

    class Positioned(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind.tag

        def schema(self) -> T.StructType:
            return kind.row_schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(kind(dict(self.options)))

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _StreamReader(kind(dict(self.options)))

    return Positioned


def register(spark: SparkSession, kind: type[PositionedSource]) -> None:
    """Make the source known by its tag: ``spark.read.format(tag)`` and ``spark.readStream.format(tag)``."""
    spark.dataSource.register(data_source(kind))


def read_source(spark: SparkSession, tag: str, **options: str) -> DataFrame:
    return spark.read.format(tag).options(**options).load()


def stream_source(spark: SparkSession, tag: str, **options: str) -> DataFrame:
    return spark.readStream.format(tag).options(**options).load()
