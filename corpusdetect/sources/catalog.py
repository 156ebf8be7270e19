"""Tagged sources, built in and user-defined."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import Filter, chain
from ..operators.setops import combined_tag, concatenate
from .connector import PositionedSource, read_source, register
from .stores import KINDS, read_store

Reader = Callable[[SparkSession], DataFrame]

# Tags of the stores that need no projection of their own.
STORE_TAGS = {
    "stackoverflow-pre": "sample",
    "stackoverflow-post": "sample",
    "generated": "sample",
    "detection": "detection",
}


class Catalog:
    """Maps tags to readers; every reader must return its kind's schema."""

    def __init__(self) -> None:
        self._readers: dict[str, tuple[Reader, str]] = {}

    def register(self, tag: str, reader: Reader, kind: str = "sample") -> None:
        """Add a source: any function from a session to a DataFrame."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        self._readers[tag] = (reader, kind)

    def register_store(self, tag: str, path: str, form: str, kind: str | None = None) -> None:
        """Add a stored table, ``parquet`` or ``xml``."""
        kind = kind or STORE_TAGS.get(tag, "sample")
        self.register(tag, lambda spark: read_store(spark, path, form, kind), kind)

    def register_source(self, spark: SparkSession, source: type[PositionedSource], kind: str = "sample", **options: str) -> None:
        """Add a source that is read by position, in parts; as a stream it goes by the same tag."""
        register(spark, source)
        self.register(source.tag, lambda session: read_source(session, source.tag, **options), kind)

    def register_table(
        self, tag: str, path: str, project: Callable[[DataFrame], DataFrame], form: str = "parquet"
    ) -> None:
        """Add a downloaded table with the projection that makes samples of its rows.

        The projection drops a row by giving it null code.
        """
        def read(spark: SparkSession) -> DataFrame:
            return project(spark.read.format(form).load(path)).dropna(subset=["Code"])

        self.register(tag, read)

    def tags(self) -> list[str]:
        return list(self._readers)

    def load(self, spark: SparkSession, tag: str, filters: Iterable[Filter] = ()) -> DataFrame:
        reader, kind = self._readers[tag]
        df = reader(spark)
        wanted = {f.name: f.dataType for f in KINDS[kind][0]}
        found = {f.name: f.dataType for f in df.schema}
        wrong = [n for n, t in wanted.items() if found.get(n) != t]
        if wrong:
            raise TypeError(f"source {tag!r} lacks or mistypes {wrong}")
        return chain(filters)(df)

    def load_all(
        self, spark: SparkSession, tags: Sequence[str], filters: Iterable[Filter] = ()
    ) -> tuple[str, DataFrame]:
        """Union of sources, with the same filters on each, and its joint tag."""
        union = concatenate([self.load(spark, t) for t in tags])
        return combined_tag(tags), chain(filters)(union)
