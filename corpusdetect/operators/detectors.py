"""Zero-shot detectors as aggregates over token statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..functions.text import prompt_hash, sample_row_hash
from ..plans.joins import lookup_join
from ..schemas import DETECTION_SCHEMA, TOKEN_STATS_SCHEMA


@dataclass(frozen=True)
class Detector:
    """A score as an aggregate over the token-statistics rows of a sample.

    Rows carry a multiplicity ``n``. ``needs_pair`` detectors see the rows of a
    registered model pair, the others those of a single model.
    """

    score: Column
    needs_pair: bool = False


def _mean(value: str, rows: Column | None = None) -> Column:
    weighted, weight = F.col("n") * F.col(value), F.col("n")
    if rows is not None:
        weighted, weight = F.when(rows, weighted), F.when(rows, weight)
    return F.try_divide(F.sum(weighted), F.sum(weight))


def log_likelihood() -> Column:
    """Mean log probability of the real tokens."""
    return _mean("logprob", ~F.col("is_pad"))


def sampling_discrepancy() -> Column:
    """Distance of the text's log probability from what the pair expects.

    Without any variance it is infinite, or NaN where the text is exactly as
    expected.
    """
    gap = F.sum(F.col("n") * F.col("logprob")) - F.sum(F.col("n") * F.col("mu"))
    variance = F.sum(F.col("n") * F.col("var"))
    return (
        F.when(variance > 0, gap / F.sqrt(variance))
        .when(gap > 0, F.lit(float("inf")))
        .when(gap < 0, F.lit(float("-inf")))
        .when(gap == 0, F.lit(float("nan")))
    )


def perplexity_ratio() -> Column:
    """Log perplexity over the pair's cross entropy; null for empty texts."""
    real = ~F.col("is_pad")
    return F.try_divide(-_mean("logprob", real), _mean("xent", real))


def perplexity_ratio_median() -> Column:
    """The same with the median cross entropy of the real tokens."""
    weight = F.when(F.col("is_pad"), F.lit(0)).otherwise(F.col("n"))
    median = F.percentile("xent", F.lit(0.5), weight)
    return F.try_divide(-_mean("logprob", ~F.col("is_pad")), median)


def detectors() -> dict[str, Detector]:
    """The built-in detectors; extend the mapping with your own."""
    return {
        "loglikelihood": Detector(log_likelihood()),
        "entropy": Detector(_mean("entropy")),
        "rank": Detector(_mean("rank")),
        "fastdetectgpt": Detector(sampling_discrepancy(), needs_pair=True),
        "binoculars": Detector(perplexity_ratio(), needs_pair=True),
    }


def score(
    stats: DataFrame, chosen: Mapping[str, Detector] | None = None, key: str = "sample_id"
) -> DataFrame:
    """``(key, BaseModel, SecondaryModel, Detector, Value)`` from token statistics.

    One aggregation computes all detectors; the scores become rows afterwards.
    """
    chosen = detectors() if chosen is None else chosen
    wide = stats.groupBy(key, "model", "model2").agg(
        *[d.score.cast("double").alias(name) for name, d in chosen.items()]
    )
    paired = F.col("model2").isNotNull()
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("Detector"),
                F.col(name).alias("Value"),
                F.lit(d.needs_pair).alias("pair"),
            )
            for name, d in chosen.items()
        ]
    )
    return wide.select(
        key,
        F.col("model").alias("BaseModel"),
        F.col("model2").alias("SecondaryModel"),
        F.inline(F.filter(listed, lambda s: s["pair"] == paired)),
    ).drop("pair")


def to_detections(
    samples: DataFrame,
    scores: DataFrame,
    now: int,
    max_length: int | None = None,
    key: str = "sample_id",
) -> DataFrame:
    """Detection rows: the sample's hashes and tags with its scores.

    ``max_length`` is recorded, the text is not cut. Joins on the unique sample
    key.
    """
    hashed = samples.withColumn("CodeSampleHash", sample_row_hash()).withColumn(
        "PromptHash", prompt_hash(F.col("OriginalPrompt"))
    )
    rows = (
        hashed.drop("Date")
        .join(scores, key)
        .withColumn("Date", F.lit(now).cast("bigint"))
        .withColumn("MaxLength", F.lit(max_length).cast("int"))
    )
    return rows.select(key, *[F.col(f.name).cast(f.dataType) for f in DETECTION_SCHEMA])


def coverage(
    models: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    scores: DataFrame,
    chosen: Mapping[str, Detector] | None = None,
) -> DataFrame:
    """Scored samples of every (detector, base model) asked for.

    A two-model detector whose base model has no registered pair has no rows;
    it is listed here with 0.
    """
    chosen = detectors() if chosen is None else chosen
    based = {base for base, _ in pairs}
    wanted = scores.sparkSession.createDataFrame(
        [(d, m, not spec.needs_pair or m in based) for d, spec in chosen.items() for m in models],
        "Detector string, BaseModel string, registered boolean",
    )
    counted = scores.groupBy("Detector", "BaseModel").agg(F.count(F.lit(1)).alias("rows"))
    return wanted.join(counted, ["Detector", "BaseModel"], "left").fillna(0, ["rows"])


def statistics_from_model(samples: DataFrame, scorer: Callable[[Iterator], Iterator]) -> DataFrame:
    """Token statistics of an external model.

    ``scorer`` maps batches of sample rows (pandas frames) to batches of
    token-statistics rows, any number per sample; it runs next to the data, so
    a model is loaded once per task.
    """
    return samples.mapInPandas(scorer, TOKEN_STATS_SCHEMA)


# ------------------------------------------------- statistics from logits


def shift_labels(dist: DataFrame) -> DataFrame:
    """Give each position of a token distribution the token that follows it.

    Adds ``label`` and ``label_pad``; the last position of a sample has no
    successor and is dropped.
    """
    order = Window.partitionBy("sample_id", "model").orderBy("pos")
    return (
        dist.withColumn("label", F.lead("token_id").over(order))
        .withColumn("label_pad", F.lead("is_pad").over(order))
        .filter(F.col("label").isNotNull())
    )


def statistics_from_logits(shifted: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Token statistics of single models from rows with ``logits`` and ``label``."""
    nothing = F.lit(None).cast("double")
    probable = shifted.withColumn("lp", pr.log_softmax(F.col("logits"), temperature))
    return probable.select(
        "sample_id",
        "model",
        F.lit(None).cast("string").alias("model2"),
        F.lit(1).cast("bigint").alias("n"),
        pr.token_logprob(F.col("lp"), F.col("label")).alias("logprob"),
        pr.entropy(F.col("lp")).alias("entropy"),
        pr.token_rank(F.col("logits"), F.col("label")).cast("double").alias("rank"),
        nothing.alias("mu"),
        nothing.alias("var"),
        nothing.alias("xent"),
        F.col("label_pad").alias("is_pad"),
    )


def _pair_positions(shifted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every position that either model of a pair has, and whether both agree on it."""
    first = lookup_join(shifted, pairs, ["model"], spread_by=["sample_id", "pos"]).select(
        "sample_id", "pos", "model", "model2", "label", "label_pad", "logits", F.lit(True).alias("here")
    )
    seconds = pairs.select("model", F.col("model2").alias("second"))
    second = (
        shifted.withColumnRenamed("model", "second")
        .join(seconds, "second")
        .select(
            "sample_id",
            "pos",
            "model",
            F.col("second").alias("model2"),
            F.col("label").alias("label2"),
            F.col("label_pad").alias("pad2"),
            F.col("logits").alias("logits2"),
            F.lit(True).alias("there"),
        )
    )
    agree = (
        F.col("here").isNotNull()
        & F.col("there").isNotNull()
        & F.col("label").eqNullSafe(F.col("label2"))
        & F.col("label_pad").eqNullSafe(F.col("pad2"))
    )
    return first.join(second, ["sample_id", "pos", "model", "model2"], "full").withColumn("agree", agree)


def pair_mismatches(shifted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(sample_id, pos, model, model2, reason)``: positions on which a pair does not agree."""
    reason = (
        F.when(F.col("there").isNull(), F.lit("first model only"))
        .when(F.col("here").isNull(), F.lit("second model only"))
        .otherwise(F.lit("different token or padding"))
    )
    rows = _pair_positions(shifted, pairs).filter(~F.col("agree"))
    return rows.select("sample_id", "pos", "model", "model2", reason.alias("reason"))


def pair_statistics_from_logits(
    shifted: DataFrame,
    pairs: DataFrame,
    temperature: float = 1.0,
    on_mismatch: str = "error",
) -> DataFrame:
    """Token statistics of model pairs; ``pairs`` is (model, model2), one row each.

    Both distributions are cut to the smaller vocabulary. Positions at which
    the models disagree on token or padding, and those that only one of them
    has, fail the job, or are left out with ``on_mismatch="drop"``
    (:func:`pair_mismatches` lists them).
    """
    joined = _pair_positions(shifted, pairs)
    if on_mismatch == "drop":
        joined = joined.filter("agree")
    elif on_mismatch == "error":
        checked = F.when(F.col("agree"), F.col("label")).otherwise(
            F.raise_error(F.lit("the two models tokenize a sample differently")).cast("int")
        )
        joined = joined.withColumn("label", checked)
    else:
        raise ValueError(f"unknown choice {on_mismatch!r}")
    cut = joined.select(
        "sample_id", "model", "model2", "label", "label_pad",
        pr.log_softmax(pr.same_vocabulary(F.col("logits"), F.col("logits2")), temperature).alias("lp"),
        pr.log_softmax(pr.same_vocabulary(F.col("logits2"), F.col("logits")), temperature).alias("ref"),
    )
    mu = pr.cross_mean(F.col("ref"), F.col("lp"))
    nothing = F.lit(None).cast("double")
    return cut.withColumn("mu", mu).select(
        "sample_id",
        "model",
        "model2",
        F.lit(1).cast("bigint").alias("n"),
        pr.token_logprob(F.col("lp"), F.col("label")).alias("logprob"),
        nothing.alias("entropy"),
        nothing.alias("rank"),
        "mu",
        F.greatest(
            pr.cross_square(F.col("ref"), F.col("lp")) - F.col("mu") * F.col("mu"), F.lit(0.0)
        ).alias("var"),
        (-F.col("mu")).alias("xent"),
        F.col("label_pad").alias("is_pad"),
    )
