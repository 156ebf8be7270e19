"""AUROC against attributes of the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_attribute(scores: DataFrame, attributes: DataFrame, name: str) -> DataFrame:
    """AUROC rows whose base model has a value other than null or 0 for ``name``.

    ``attributes`` is the model registry, one row per ``model``.
    """
    present = attributes.filter(F.col(name).isNotNull() & (F.col(name) != 0)).select(
        F.col("model").alias("BaseModel"), F.col(name).cast("double").alias("attribute")
    )
    return scores.join(F.broadcast(present), "BaseModel")


def trend(points: DataFrame) -> DataFrame:
    """Least-squares line of AUROC on the attribute, per detector."""
    return points.groupBy("Detector").agg(
        F.regr_slope("auroc", "attribute").alias("slope"),
        F.regr_intercept("auroc", "attribute").alias("intercept"),
        F.count(F.lit(1)).alias("models"),
    )
