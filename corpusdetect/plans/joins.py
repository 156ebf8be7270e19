"""Joins of a large side with a lookup side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    max_rows: int | None = None,
    salts: int = 1,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``on``, nulls being equal; ``how`` keeps or filters the big side.

    Without ``max_rows`` Spark chooses: it broadcasts a side whose measured size is small, and
    adaptive execution cuts the partition of a key with a third of the big side into tasks of normal
    size. Nothing is run to find out. For a small side that is written already, ``max_rows`` checks its
    rows and broadcasts it up to that many; ``fits`` is the outcome of an earlier check. In sessions
    without adaptive execution set ``salts``: a big row goes to the part of its key given by a hash of
    its ``spread_by`` columns, a small row to all parts.
    """
    on = list(on)
    if fits is None:
        fits = max_rows is not None and fits_broadcast(small, max_rows)
    if salts > 1 and not fits:
        spread = [F.col(c) for c in (spread_by or big.columns)]
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [*on, "_salt"]
    renamed = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, [big[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on])
    joined = big.join(F.broadcast(renamed) if fits else renamed, same, how)
    return joined.drop(*[f"_on_{c}" for c in on], "_salt")
