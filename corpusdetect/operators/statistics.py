"""Counts over sample and detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Dataset").agg(F.count(F.lit(1)).alias("rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their row counts, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "value")
    )


def column_counts(df: DataFrame) -> DataFrame:
    """Non-null values per column, one row per column."""
    totals = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return totals.unpivot([], df.columns, "column", "values")
