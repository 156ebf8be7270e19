"""Scalar rules for detector scores and token shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HUMAN

# Stand-in for infinite scores, and for missing ones against the detector.
SCORE_CAP = 100000.0

# Detectors whose lower scores mean machine-generated.
FLIPPED = ("binoculars", "detectcodegpt", "rank")


def is_human(generator: Column) -> Column:
    return generator == HUMAN


def finite_score(value: Column, generator: Column) -> Column:
    """Replace non-finite scores.

    A missing score (null or NaN) counts as the cap on the side of the wrong
    class; infinities become the cap of their sign.
    """
    missing = value.isNull() | F.isnan(value)
    infinity = float("inf")
    return (
        F.when(missing & is_human(generator), F.lit(SCORE_CAP))
        .when(missing, F.lit(-SCORE_CAP))
        .when(value == F.lit(infinity), F.lit(SCORE_CAP))
        .when(value == F.lit(-infinity), F.lit(-SCORE_CAP))
        .otherwise(value)
    )


def oriented_score(
    value: Column,
    generator: Column,
    detector: Column,
    flip: Sequence[str] = (),
    pessimistic_after_flip: bool = False,
) -> Column:
    """Finite score, negated for the detectors in ``flip``.

    By default missing scores are replaced before the sign changes, so that
    for a flipped detector they end on the favourable side;
    ``pessimistic_after_flip`` replaces them after it.
    """
    flipped = detector.isin(*flip) if flip else F.lit(False)
    if pessimistic_after_flip:
        return finite_score(F.when(flipped, -value).otherwise(value), generator)
    score = finite_score(value, generator)
    return F.when(flipped, -score).otherwise(score)


def informativeness(human_share: Column, ai_share: Column) -> Column:
    """Signed weight of a token; positive where it is typical of generated code."""
    from_identity = (ai_share - human_share) / F.sqrt(F.lit(2.0))
    from_origin = F.sqrt(F.pow(human_share, F.lit(2.0)) + F.pow(ai_share, F.lit(2.0)))
    return from_identity * from_origin


def default_setting(top_p: float = 0.95, temperature: float = 0.97) -> Column:
    """Rows generated with the setting, and all human rows (which have none)."""
    return ((F.col("TopP") == top_p) & (F.col("Temperature") == temperature)) | is_human(
        F.col("Generator")
    )


def seeded_bits(seed: int, *parts: Column) -> Column:
    """A whole number below 2 ** 32 that depends on the seed and the row's keys only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the row's keys only."""
    return seeded_bits(seed, *parts).cast("double") / F.lit(4294967296.0)
