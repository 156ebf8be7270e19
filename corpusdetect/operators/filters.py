"""Sample filters: functions from DataFrame to DataFrame.

All but the hash-list and index filters are plain predicates, which Spark
pushes through unions and into file scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import canonical_language
from ..functions.text import calendar_epoch, sample_row_hash
from ..functions.tokens import Tokenizer, token_count, words
from ..plans.joins import fits_broadcast, lookup_join
from ..plans.ranking import global_index
from ..plans.sketch import may_contain
from ..plans.storage import materialize
from ..schemas import HUMAN

Filter = Callable[[DataFrame], DataFrame]

# Order keys of an index filter sent to every executor.
CHOSEN = 1_000_000


def _bound(date: int | tuple[int, int, int]) -> int:
    return calendar_epoch(*date) if isinstance(date, tuple) else date


def where(condition: Column) -> Filter:
    """Filter by any boolean column (the extension point for users)."""
    return lambda df: df.filter(condition)


def after_date(date: int | tuple[int, int, int]) -> Filter:
    """Strictly after an epoch second, or after midnight UTC of (y, m, d)."""
    return where(F.col("Date") > F.lit(_bound(date)))


def before_date(date: int | tuple[int, int, int]) -> Filter:
    return where(F.col("Date") < F.lit(_bound(date)))


def languages(names: Sequence[str]) -> Filter:
    """Rows whose language, in any spelling, is one of the canonical ``names``."""
    return where(canonical_language(F.col("Language")).isin(*names))


def length(span: range, tokenizer: Tokenizer = words, column: str = "Code") -> Filter:
    """Rows whose token count lies in ``span``, its step included."""
    count = token_count(tokenizer(F.col(column)))
    on_step = (count - F.lit(span.start)) % F.lit(span.step) == 0
    return where((count >= span.start) & (count < span.stop) & on_step)


def distribution(hashes: DataFrame, row_hash: Column | None = None, sketch: DataFrame | None = None) -> Filter:
    """Rows whose sample hash occurs in ``hashes`` (one column ``hash``).

    With a ``sketch`` of the hashes (:mod:`plans.sketch`) rows that surely do not occur are dropped in the
    scan, and only the others are shuffled to meet the list.
    """
    key = sample_row_hash() if row_hash is None else row_hash

    def apply(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("hash", key)
        if sketch is not None:
            # Spark would push a semi join below the sketch's.
            return lookup_join(may_contain(keyed, sketch, "hash"), hashes.select("hash").distinct(), ["hash"]).drop("hash")
        return lookup_join(keyed, hashes.select("hash"), ["hash"], "left_semi").drop("hash")

    return apply


def index(span: range, order: Sequence[Column], descending: bool = False) -> Filter:
    """Rows whose number, counted from 0 in ``order`` after earlier filters, is in ``span``.

    Only order keys are sorted and numbered. Up to CHOSEN keys of the span go to every executor, so that
    no other row is moved; of rows with equal keys as many stay as have a number in the span.
    """

    def apply(df: DataFrame) -> DataFrame:
        names = [f"o{i}" for i in range(len(order))]
        key = [o.alias(n) for o, n in zip(order, names)]
        ranked = global_index(df.select(*key), [F.desc(n) if descending else F.asc(n) for n in names], "_index")
        position = F.col("_index")
        on_step = (position - F.lit(span.start)) % F.lit(span.step) == 0
        inside = (position >= span.start) & (position < span.stop) & on_step
        chosen = ranked.filter(inside).groupBy(*names).agg(F.count(F.lit(1)).alias("_chosen"))
        chosen = materialize(chosen, "chosen")
        small = F.broadcast(chosen) if fits_broadcast(chosen, CHOSEN) else chosen
        rows = df.select(F.struct("*").alias("row"), F.struct(*key).alias("key"))
        small = small.select(F.struct(*names).alias("_key"), "_chosen")
        met = rows.join(small, F.col("key").eqNullSafe(F.col("_key")))
        # Of rows with one key all, or as many as are chosen.
        all_of = ranked.groupBy(*names).agg(F.count(F.lit(1)).alias("_all")).where("_all > 1")
        tied = materialize(all_of.select(F.struct(*names).alias("_tied"), "_all"), "ties")
        if tied.isEmpty():
            return met.select("row.*")
        met = met.join(F.broadcast(tied) if fits_broadcast(tied, CHOSEN) else tied, F.col("key").eqNullSafe(F.col("_tied")), "left")
        partly = met.where("_all > _chosen").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("row")))
        whole = met.where("_all IS NULL OR _all = _chosen").select("row.*")
        return whole.union(partly.where("_n <= _chosen").select("row.*"))

    return apply


def chain(filters: Iterable[Filter]) -> Filter:
    """All filters, in order."""
    return lambda df: reduce(lambda rows, step: step(rows), filters, df)


def corpus(datasets: Sequence[str] | None = None, names: Sequence[str] | None = None) -> Filter:
    """Slice by corpus tags and canonical languages; None leaves a side open."""

    def apply(df: DataFrame) -> DataFrame:
        if datasets is not None:
            df = df.filter(F.col("Dataset").isin(*datasets))
        if names is not None:
            df = df.filter(F.col("Language").isin(*names))
        return df

    return apply


def generator(name: str) -> Filter:
    """One generator against human rows."""
    return where(F.col("Generator").isin(name, HUMAN))


def white_box() -> Filter:
    """Generated rows scored by their own generator, and human rows."""
    return where((F.col("Generator") == F.col("BaseModel")) | (F.col("Generator") == HUMAN))


def base_model(name: str) -> Filter:
    return where(F.col("BaseModel") == name)


def second_model(name: str | None) -> Filter:
    """Rows scored with the given second model; None keeps those without one."""
    return where(F.col("SecondaryModel").eqNullSafe(F.lit(name)))


def supported(samples: DataFrame, capability: DataFrame) -> DataFrame:
    """Every sample once per model that supports its language.

    ``capability`` holds (model, Language); one row per supported pair.
    """
    return lookup_join(samples, capability, ["Language"], "inner")


def unsupported(samples: DataFrame, capability: DataFrame, models: Sequence[str]) -> DataFrame:
    """The (sample, model) combinations that :func:`supported` leaves out."""
    fanned = samples.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return lookup_join(fanned, capability, ["model", "Language"], "left_anti")
