"""Generator x base-model matrices of AUROCs, as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import FLIPPED
from ..plans.joins import lookup_join
from ..schemas import HUMAN
from .evaluation import auroc



def heatmap(
    detections: DataFrame,
    generators: Sequence[str],
    base_models: Sequence[str],
    detectors: Sequence[str],
    by: Sequence[str] = (),
    split_second: bool = False,
) -> DataFrame:
    """``(by…, Detector, Generator, BaseModel, value, has_data)`` for every cell.

    All cells of all slices in ``by`` come from one AUROC pass. Cells without
    data hold 0. ``split_second`` keeps second models apart (a column
    ``SecondaryModel``, null for single-model scores) instead of pooling them;
    it and ``by`` list the slices that occur.
    """
    slices = list(by) + (["SecondaryModel"] if split_second else [])
    axes = {"Detector": detectors, "Generator": generators, "BaseModel": base_models}
    rows = detections.filter(
        F.col("BaseModel").isin(*base_models)
        & F.col("Detector").isin(*detectors)
        & F.col("Generator").isin(*generators, HUMAN)
    )
    cell = F.struct(*axes)
    # A slice gathers at most as many cells as its figure has; spreading the
    # axes next to them fills the gaps without a join.
    held = (
        auroc(rows, by=slices + ["Detector", "BaseModel"])
        .groupBy(*slices)
        .agg(F.map_from_entries(F.collect_list(F.struct(cell, "auroc"))).alias("cells"))
    )
    for name, values in axes.items():
        held = held.withColumn(name, F.explode(F.lit(list(values))))
    value = F.try_element_at("cells", cell)
    return held.select(
        *slices,
        *axes,
        F.coalesce(value, F.lit(0.0)).alias("value"),
        value.isNotNull().alias("has_data"),
    )


def best_detector(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest AUROC of any detector per cell, not below 0, before any flipping."""
    return cells.groupBy(*by, "Generator", "BaseModel").agg(
        F.greatest(F.max("value"), F.lit(0.0)).alias("value")
    )


def display_flip(cells: DataFrame, flip: Sequence[str] = FLIPPED) -> DataFrame:
    """Values as drawn: ``1 - v`` for flipped detectors, empty cells included."""
    shown = F.when(F.col("Detector").isin(*flip), F.lit(1.0) - F.col("value"))
    return cells.withColumn("value", shown.otherwise(F.col("value")))


def scale_bounds(cells: DataFrame, flip: Sequence[str] = FLIPPED, difference: bool = False) -> DataFrame:
    """``(Detector, vmin, vmax)`` of the colour scale, mirrored where flipped."""
    low, high = F.min("value"), F.max("value")
    flipped = F.col("Detector").isin(*flip)
    mirror = (lambda c: -c) if difference else (lambda c: F.lit(1.0) - c)
    ends = cells.groupBy("Detector").agg(low.alias("low"), high.alias("high"))
    vmin = F.when(flipped, mirror(F.col("high"))).otherwise(F.col("low")) if difference else F.lit(0.0)
    return ends.select(
        "Detector",
        vmin.alias("vmin"),
        F.when(flipped, mirror(F.col("low"))).otherwise(F.col("high")).alias("vmax"),
    )


def matrix(cells: DataFrame, base_models: Sequence[str], by: Sequence[str] = ("Detector",)) -> DataFrame:
    """One line per generator, one column per base model, two digits."""
    return (
        cells.groupBy(*by, "Generator")
        .pivot("BaseModel", list(base_models))
        .agg(F.round(F.first("value"), 2))
    )


def difference(comparison: DataFrame, base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Comparison minus base where both have the cell.

    Inputs are AUROC tables with (by…, Detector, Generator, BaseModel, auroc); a null key, such as
    no second model, meets its like.
    """
    key = list(by) + ["Detector", "Generator", "BaseModel"]
    left = comparison.select(*key, F.col("auroc").alias("comparison"))
    right = base.select(*key, F.col("auroc").alias("base"))
    return lookup_join(left, right, key).withColumn("diff", F.col("comparison") - F.col("base"))


def detector_order(detectors: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in detectors]), F.col("Detector"))


def widest_difference(diffs: DataFrame, detectors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Signed difference of the largest size per cell; the earlier detector wins ties."""
    size = F.struct(F.abs(F.col("diff")).alias("size"), (-detector_order(detectors)).alias("ord"))
    return diffs.groupBy(*by, "Generator", "BaseModel").agg(
        F.max_by("diff", size).alias("diff")
    )


def diagonal_adjusted(diffs: DataFrame) -> DataFrame:
    """Off-diagonal differences less the mean of their two diagonal cells.

    Needs both diagonal cells (generator, generator) and (base, base); the
    diagonal itself becomes 0.
    """
    diagonal = diffs.filter(F.col("Generator") == F.col("BaseModel"))
    of_generator = diagonal.select("Detector", "Generator", F.col("diff").alias("dg"))
    of_base = diagonal.select("Detector", "BaseModel", F.col("diff").alias("db"))
    joined = diffs.join(of_generator, ["Detector", "Generator"]).join(
        of_base, ["Detector", "BaseModel"]
    )
    adjusted = F.when(F.col("Generator") == F.col("BaseModel"), F.lit(0.0)).otherwise(
        F.col("diff") - (F.col("dg") + F.col("db")) / F.lit(2.0)
    )
    return joined.select("Detector", "Generator", "BaseModel", adjusted.alias("diff"))


def paired_scores(diffs: DataFrame, generators: Sequence[str], base_models: Sequence[str]) -> DataFrame:
    """Both corpora's AUROCs per detector in generator-major order, one row each."""
    g = F.array_position(F.array(*[F.lit(x) for x in generators]), F.col("Generator"))
    b = F.array_position(F.array(*[F.lit(x) for x in base_models]), F.col("BaseModel"))
    place = F.row_number().over(Window.partitionBy("Detector").orderBy("g", "b"))
    return (
        diffs.withColumn("g", g)
        .withColumn("b", b)
        .withColumn("place", place)
        .select("Detector", "place", "comparison", "base")
        .orderBy("Detector", "place")
    )
