"""AUROC, ROC curves and their summaries over detection rows.

The work is done on score histograms: rows are first counted per distinct
score, and human rows are never repeated per generator. Cumulative counts run
inside range buckets and are shifted by per-bucket totals, so neither a
detector with billions of distinct scores nor one hot group ends in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import is_human, oriented_score
from ..plans.joins import lookup_join
from ..plans.ranking import range_buckets
from ..plans.storage import materialize


def score_histogram(
    detections: DataFrame,
    by: Sequence[str],
    ai_by: Sequence[str],
    flip: Sequence[str] = (),
    pessimistic_after_flip: bool = False,
) -> DataFrame:
    """``(by…, ai_by…, human, v, n)``: how often each oriented score occurs.

    ``by`` splits human and generated rows alike, ``ai_by`` only the generated
    ones (its columns are null on human rows).
    """
    human = is_human(F.col("Generator"))
    split = [F.when(~human, F.col(c)).alias(c) for c in ai_by]
    value = oriented_score(
        F.col("Value"), F.col("Generator"), F.col("Detector"), flip, pessimistic_after_flip
    )
    return (
        detections.select(*by, *split, human.alias("human"), value.alias("v"))
        .groupBy(*by, *ai_by, "human", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def auroc(
    detections: DataFrame,
    by: Sequence[str] = ("Detector", "BaseModel"),
    ai_by: Sequence[str] = ("Generator",),
    flip: Sequence[str] = (),
    pessimistic_after_flip: bool = False,
) -> DataFrame:
    """Area under the ROC curve of every group, ties counted half.

    Returns ``(by…, ai_by…, n_human, n_ai, auroc)``. Groups that lack one of
    the classes have no row. With empty ``ai_by`` all generators are pooled.
    """
    by, ai_by = list(by), list(ai_by)
    hist = score_histogram(detections, by, ai_by, flip, pessimistic_after_flip)
    counted = range_buckets(hist, by, "v").select(
        *by,
        *ai_by,
        "_bucket",
        "v",
        F.when(F.col("human"), F.col("n")).otherwise(F.lit(0)).alias("hc"),
        F.when(F.col("human"), F.lit(0)).otherwise(F.col("n")).alias("ac"),
    )
    bucket = by + ["_bucket"]
    # Both frames share one sort: everything up to the score, and its peers.
    by_score = Window.partitionBy(*bucket).orderBy("v")
    at_most = F.sum("hc").over(by_score)
    tied = F.sum("hc").over(by_score.rangeBetween(Window.currentRow, Window.currentRow))
    # Human scores below each generated one, first within its bucket ...
    per_bucket = (
        counted.withColumn("le", at_most)
        .withColumn("ties", tied)
        .groupBy(*bucket, *ai_by)
        .agg(
            F.sum("hc").alias("hb"),
            F.sum("ac").alias("ab"),
            F.sum(F.col("ac") * (F.col("le") - F.col("ties") / F.lit(2.0))).alias("wins"),
        )
    )
    # ... then in all lower buckets: at most generators x partitions rows a group.
    group = Window.partitionBy(*by)
    lower = F.sum("hb").over(group.orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1))
    return (
        per_bucket.withColumn("below", F.coalesce(lower, F.lit(0)))
        .withColumn("n_human", F.sum("hb").over(group))
        .filter((F.col("ab") > 0) & (F.col("n_human") > 0))
        .groupBy(*by, *ai_by, "n_human")
        .agg(
            F.sum("ab").alias("n_ai"),
            F.sum(F.col("wins") + F.col("ab") * F.col("below")).alias("_wins"),
        )
        .select(
            *by,
            *ai_by,
            "n_human",
            "n_ai",
            (F.col("_wins") / (F.col("n_human").cast("double") * F.col("n_ai"))).alias("auroc"),
        )
    )


def roc_curve(
    detections: DataFrame,
    by: Sequence[str] = ("Detector", "BaseModel"),
    flip: Sequence[str] = (),
    pessimistic_after_flip: bool = False,
) -> DataFrame:
    """Points of the ROC curve of every (by…, Generator) against human rows.

    One row per point: ``point`` (0 is the origin with threshold +inf), ``fpr``,
    ``tpr``, ``threshold``. A point is left out when the counts gained at it and
    at the next one are the same. Curves are rows, not arrays, so their length
    is not bounded by memory.

    A distinct score is one row with the counts of all generators until scores are placed by range; only
    then does a generator's curve get the scores that it or the humans have.
    """
    by = list(by)
    cell = by + ["Generator"]
    hist = materialize(
        score_histogram(detections, by, ["Generator"], flip, pessimistic_after_flip), "scores"
    )
    own = F.struct("Generator", "n")
    per_score = hist.groupBy(*by, "v").agg(
        F.sum(F.when(F.col("human"), F.col("n")).otherwise(F.lit(0))).alias("hc"),
        F.collect_list(F.when(~F.col("human"), own)).alias("ais"),
    )
    # Thresholds fall along the curve, so order by the negated score.
    spread = materialize(range_buckets(per_score.withColumn("d", -F.col("v")), by, "d"), "curve")
    # The generators of a group: one row a group.
    rivals = hist.filter("not human").groupBy(*by).agg(F.collect_set(F.struct("Generator")).alias("rivals"))
    each = lookup_join(spread, rivals, by, spread_by=["d"]).withColumn("rival", F.explode("rivals"))
    theirs = F.filter("ais", lambda x: x["Generator"].eqNullSafe(F.col("rival.Generator")))
    placed = (
        each.withColumn("ac", F.coalesce(F.get(theirs, F.lit(0))["n"], F.lit(0)))
        .filter("hc > 0 OR ac > 0")
        .select(*by, F.col("rival.Generator").alias("Generator"), "_bucket", "v", "d", "hc", "ac")
    )

    bucket = cell + ["_bucket"]
    gained = F.struct("hc", "ac")
    summary = placed.groupBy(*bucket).agg(
        F.sum("hc").alias("hb"), F.sum("ac").alias("ab"), F.min_by(gained, "d").alias("head")
    )
    # One row per bucket and curve from here on, as in auroc().
    ordered = Window.partitionBy(*cell).orderBy("_bucket")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*cell)
    summary = summary.select(
        *bucket,
        F.coalesce(F.sum("hb").over(earlier), F.lit(0)).alias("h0"),
        F.coalesce(F.sum("ab").over(earlier), F.lit(0)).alias("a0"),
        F.lead("head").over(ordered).alias("next_head"),
        F.row_number().over(ordered).alias("nth"),
        F.sum("hb").over(whole).alias("n_human"),
        F.sum("ab").over(whole).alias("n_ai"),
    ).filter((F.col("n_human") > 0) & (F.col("n_ai") > 0))

    inside = Window.partitionBy(*bucket).orderBy("d")
    points = (
        placed.withColumn("hi", F.sum("hc").over(inside))
        .withColumn("ai", F.sum("ac").over(inside))
        .withColumn("next_in", F.lead(gained).over(inside))
        .withColumn("row", F.row_number().over(inside))
    )
    points = lookup_join(points, summary, bucket, spread_by=["d"])
    following = F.coalesce("next_in", "next_head")
    first = (F.col("nth") == 1) & (F.col("row") == 1)
    kept = points.filter(first | following.isNull() | (following != gained)).select(
        *bucket,
        F.col("d"),
        ((F.col("h0") + F.col("hi")) / F.col("n_human")).alias("fpr"),
        ((F.col("a0") + F.col("ai")) / F.col("n_ai")).alias("tpr"),
        F.col("v").alias("threshold"),
        first.alias("first"),
    )
    origin = kept.filter("first").select(
        *bucket,
        F.lit(float("-inf")).alias("d"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"),
    )
    return kept.drop("first").unionByName(origin)


def auroc_summary(scores: DataFrame, by: Sequence[str] = ("Detector",)) -> DataFrame:
    """Mean, population deviation and extremes of the AUROCs per detector."""
    return scores.groupBy(*by).agg(
        F.avg("auroc").alias("mean"),
        F.stddev_pop("auroc").alias("std"),
        F.min("auroc").alias("min"),
        F.max("auroc").alias("max"),
    )


def overall_summary(summary: DataFrame) -> DataFrame:
    """Plain means of the detectors' means and deviations."""
    return summary.agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def auroc_ranking(scores: DataFrame) -> DataFrame:
    """Base models from best to worst per detector (few rows each)."""
    order = Window.partitionBy("Detector").orderBy(F.desc("auroc"), "BaseModel")
    return scores.withColumn("place", F.row_number().over(order)).orderBy("Detector", "place")
