"""Token frequencies of human-written and generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import informativeness
from ..functions.tokens import Tokenizer, words
from ..plans.joins import lookup_join
from ..plans.storage import materialize, spread_small
from ..schemas import HUMAN


def token_frequencies(
    samples: DataFrame,
    by: Sequence[str] = ("Generator",),
    tokenizer: Tokenizer = words,
    column: str = "Code",
) -> DataFrame:
    """``(by…, token, cnt)`` over whole texts; counted before the shuffle."""
    texts = spread_small(samples.select(*by, column))
    return (
        texts.select(*by, F.explode(tokenizer(F.col(column))).alias("token"))
        .groupBy(*by, "token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def token_shares(frequencies: DataFrame, by: Sequence[str] = ("Generator",)) -> DataFrame:
    """Adds ``total`` and ``share`` of the token among its group's tokens."""
    by = list(by)
    totals = frequencies.groupBy(*by).agg(F.sum("cnt").alias("total"))
    return lookup_join(frequencies, totals, by, spread_by=["token"]).withColumn(
        "share", F.col("cnt") / F.col("total").cast("double")
    )


def compare_tokens(frequencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every generator against the human side of its slice.

    ``(by…, Generator, token, human_share, ai_share, heuristic)`` for each token
    of either side; a token missing on one side has share 0 there. Slices that
    lack one side have no rows.
    """
    slices = list(by)
    counts = materialize(frequencies, "tokens")
    human, ai = counts.filter(F.col("Generator") == HUMAN), counts.filter(F.col("Generator") != HUMAN)
    # One small row per comparison with the totals of its two sides ...
    ai_totals = ai.groupBy(*slices, "Generator").agg(F.sum("cnt").alias("at"))
    human_totals = human.groupBy(*slices).agg(F.sum("cnt").alias("ht"))
    same_slice = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in slices], F.lit(True))
    totals = materialize(
        ai_totals.join(human_totals.withColumnsRenamed({c: f"_{c}" for c in slices}), same_slice)
        .filter("ht > 0 and at > 0")
        .select(*slices, "Generator", "ht", "at"),
        "totals",
    )
    # ... and a human token meets all generators of its slice.
    rivals = totals.groupBy(*slices).agg(F.collect_list("Generator").alias("rivals"))
    met = lookup_join(human, rivals, slices, spread_by=["token"]) if slices else human.crossJoin(F.broadcast(rivals))
    zero = F.lit(0).cast("bigint")
    pairs = (
        ai.select(*slices, "Generator", "token", zero.alias("hc"), F.col("cnt").alias("ac"))
        .unionByName(
            met.select(
                *slices, F.explode("rivals").alias("Generator"), "token", F.col("cnt").alias("hc"), zero.alias("ac")
            )
        )
        .groupBy(*slices, "Generator", "token")
        .agg(F.sum("hc").alias("hc"), F.sum("ac").alias("ac"))
    )
    compared = lookup_join(pairs, totals, slices + ["Generator"], spread_by=["token"])
    human_share = F.col("hc") / F.col("ht").cast("double")
    ai_share = F.col("ac") / F.col("at").cast("double")
    return compared.select(
        *slices,
        "Generator",
        "token",
        human_share.alias("human_share"),
        ai_share.alias("ai_share"),
        informativeness(human_share, ai_share).alias("heuristic"),
    )


def top_tokens(compared: DataFrame, by: Sequence[str] = (), limit: int = 15) -> DataFrame:
    """The most telling tokens per comparison and the class each speaks for.

    Spark keeps ``limit`` rows per group in every task before the shuffle.
    """
    order = Window.partitionBy(*by, "Generator").orderBy(
        F.desc(F.abs(F.col("heuristic"))), "token"
    )
    return (
        compared.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .withColumn("class", F.when(F.col("heuristic") < 0, F.lit("human")).otherwise(F.lit("ai")))
    )
