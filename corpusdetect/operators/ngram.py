"""Token scorer: smoothed bigram models trained and applied with aggregates.

A model is a table of counts, so training is one aggregation for all models
and scoring is a lookup. Probabilities are add-alpha smoothed over one shared
vocabulary; what a context never saw is handled in closed form, so no row is
ever as wide as the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import Tokenizer, characters
from ..plans.joins import lookup_join
from ..plans.storage import materialize, spread_small

# Most statistics entries sent to every executor (some 100 bytes each).
BROADCAST_ENTRIES = 1_000_000
# Tokens (or bytes of text) and texts that a task counts at once, and rows that it hands on at once.
TOKENS_AT_ONCE = 2_000_000
TEXTS_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 250_000
# Counts take few bytes, so files of so many rows keep a task from reading too many of them.
COUNTS_PER_FILE = 100_000


@dataclass(frozen=True)
class BigramModels:
    """``counts`` is (model, ctx, token, c); all models share a vocabulary."""

    names: tuple[str, ...]
    counts: DataFrame
    vocabulary_size: int
    alpha: float = 1.0


def bigram_counts(
    samples: DataFrame,
    keep: Sequence[str] = ("sample_id",),
    tokenizer: Tokenizer = characters,
    column: str = "Code",
) -> DataFrame:
    """``(keep…, ctx, token, n)`` of whole texts, written to shared storage.

    The first element of ``keep`` identifies the sample. The first token of a
    text has a null ``ctx``, a text without tokens one row with a null token.
    Training and scoring both start from this table, so a text is tokenized
    once. A text is counted in the task that reads it, as numbers sorted in
    stretches of bounded length: neither texts nor their tokens are shuffled,
    no hash table grows with a task's input, and the rows of a text stay
    together, so later sums per sample combine in the task that reads them. A
    key that comes twice has the rows of both its texts.
    """
    # Characters are taken apart where they are counted, other tokens by their expression.
    taken = F.col(column).cast("string") if tokenizer is characters else tokenizer(F.col(column)).cast("array<string>")
    texts = spread_small(samples.select(*keep, taken.alias("_taken")))
    kept = texts.drop("_taken").schema.fields
    text, number = T.StringType(), T.LongType()
    out = T.StructType([*kept, T.StructField("ctx", text), T.StructField("token", text), T.StructField("n", number)])
    return materialize(texts.mapInArrow(_counted, out), "bigrams", COUNTS_PER_FILE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's bigrams with their counts; the last column holds texts or lists of tokens."""
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        taken = batch.column(batch.num_columns - 1)
        measured = pc.binary_length(taken) if pa.types.is_string(taken.type) else pc.list_value_length(taken)
        sizes[:] = pc.fill_null(measured, 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(batch):
            reach = (ends[start - 1] if start else 0) + TOKENS_AT_ONCE
            end = min(max(int(np.searchsorted(ends, reach, "right")), start + 1), start + TEXTS_AT_ONCE, len(batch))
            found = _bigrams_of(batch.slice(start, end - start))
            for at in range(0, len(found), ROWS_AT_ONCE):
                yield found.slice(at, ROWS_AT_ONCE)
            start = end


def _bigrams_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A bigram of a text is one number: its text's, its first and its second token's."""
    lengths, codes, tokens = _numbered(batch.column(batch.num_columns - 1))
    kinds, some = len(tokens) + 1, lengths > 0  # the last number stands for no token
    starts = (np.cumsum(lengths) - lengths)[some]
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[starts] = len(tokens)
    keys = (np.repeat(np.arange(len(lengths)), lengths) * kinds + before) * kinds + codes
    empty = (np.flatnonzero(~some) * kinds + len(tokens)) * kinds + len(tokens)
    keys, n = np.unique(np.concatenate([keys, empty]), return_counts=True)
    pairs, second = np.divmod(keys, kinds)
    rows, first = np.divmod(pairs, kinds)
    named = pa.concat_arrays([tokens, pa.nulls(1, pa.string())])
    columns = [batch.column(i).take(pa.array(rows)) for i in range(batch.num_columns - 1)]
    columns += [named.take(pa.array(first)), named.take(pa.array(second)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "ctx", "token", "n"])


def _numbered(taken: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many tokens each text has, all tokens as numbers, and the tokens that the numbers stand for."""
    if pa.types.is_string(taken.type):
        lengths = pc.fill_null(pc.utf8_length(taken), 0).to_numpy(zero_copy_only=False)
        whole = "".join(t for t in taken.to_pylist() if t is not None)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        used = np.flatnonzero(np.bincount(points, minlength=1))
        numbers = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        numbers[used] = np.arange(len(used))
        return lengths.astype(np.int64), numbers[points], pa.array(map(chr, used.tolist()), pa.string())
    lengths = pc.fill_null(pc.list_value_length(taken), 0).to_numpy(zero_copy_only=False)
    coded = taken.flatten().dictionary_encode(null_encoding="encode")
    return lengths.astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def train(
    counted: DataFrame,
    names: Sequence[str],
    vocabulary_of: DataFrame | None = None,
    alpha: float = 1.0,
) -> BigramModels:
    """Sum bigram counts per model; ``counted`` has a column ``model``.

    The vocabulary is that of ``vocabulary_of`` (counts of all texts to be
    trained or scored on, by default ``counted`` itself). Counts are reduced in
    each task before the shuffle, so frequent bigrams cost no more than rare
    ones.
    """
    counts = materialize(
        counted.filter(F.col("model").isin(*names) & F.col("ctx").isNotNull())
        .groupBy("model", "ctx", "token")
        .agg(F.sum("n").alias("c")),
        "model",
    )
    every = counted if vocabulary_of is None else vocabulary_of
    size = every.agg(F.count_distinct("token")).first()[0]
    return BigramModels(tuple(names), counts, size, alpha)


def single_statistics(models: BigramModels) -> DataFrame:
    """``(model, ctx, n, k, entropy)``: occurrences, successors and entropy of contexts."""
    a, v = F.lit(float(models.alpha)), F.lit(float(models.vocabulary_size))
    mass = F.col("c") + a
    grouped = models.counts.groupBy("model", "ctx").agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(mass * F.log(mass)).alias("plogp"),
    )
    total = F.col("n") + a * v
    rest = (v - F.col("k")) * a / total
    seen = (F.col("plogp") - F.log(total) * (F.col("n") + a * F.col("k"))) / total
    return grouped.select("model", "ctx", "n", "k", (-seen - rest * F.log(a / total)).alias("entropy"))


def pair_statistics(models: BigramModels, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(model, model2, ctx, n, mu, var)`` for contexts that either model saw.

    ``mu`` and ``var`` are mean and variance of the base model's log
    probability under the second model; ``n`` counts the base model's context.
    """
    a, v = F.lit(float(models.alpha)), F.lit(float(models.vocabulary_size))
    roles: dict[str, list] = {}
    for base, second in pairs:
        roles.setdefault(base, []).append((base, second, 1, 0))
        roles.setdefault(second, []).append((base, second, 0, 1))
    listed = F.create_map(
        *[
            part
            for name, uses in roles.items()
            for part in (
                F.lit(name),
                F.array(
                    *[
                        F.struct(
                            F.lit(b).alias("base"), F.lit(s).alias("second"),
                            F.lit(f).alias("as_base"), F.lit(g).alias("as_second"),
                        )
                        for b, s, f, g in uses
                    ]
                ),
            )
        ]
    )
    # Each count row is handed to the pairs it takes part in, then both sides meet.
    both = (
        models.counts.select("ctx", "token", "c", F.inline(F.try_element_at(listed, F.col("model"))))
        .groupBy("base", "second", "ctx", "token")
        .agg(
            F.sum(F.col("c") * F.col("as_base")).alias("c1"),
            F.sum(F.col("c") * F.col("as_second")).alias("c2"),
        )
    )
    weight, logmass = F.col("c2") + a, F.log(F.col("c1") + a)
    sums = both.groupBy("base", "second", "ctx").agg(
        F.sum("c1").alias("n1"),
        F.sum("c2").alias("n2"),
        F.count(F.lit(1)).alias("k"),
        F.sum(weight).alias("w"),
        F.sum(weight * logmass).alias("wl"),
        F.sum(weight * logmass * logmass).alias("wll"),
    )
    d1, d2 = F.col("n1") + a * v, F.col("n2") + a * v
    rest, low = (v - F.col("k")) * a / d2, F.log(a / d1)
    mean = (F.col("wl") - F.log(d1) * F.col("w")) / d2 + rest * low
    square = (
        F.col("wll") - F.lit(2.0) * F.log(d1) * F.col("wl") + F.log(d1) * F.log(d1) * F.col("w")
    ) / d2 + rest * low * low
    return sums.select(
        F.col("base").alias("model"),
        F.col("second").alias("model2"),
        "ctx",
        F.col("n1").alias("n"),
        mean.alias("mu"),
        F.greatest(square - mean * mean, F.lit(0.0)).alias("var"),
    )


def token_statistics(
    counted: DataFrame,
    models: BigramModels,
    pairs: Sequence[tuple[str, str]] = (),
    single: bool = True,
    key: str = "sample_id",
) -> DataFrame:
    """Statistics of every scored token, for all models and pairs at once.

    ``counted`` comes from :func:`bigram_counts`. Rows follow the
    token-statistics schema; equal bigrams of a sample are one row with their
    count ``n``. The statistics come from two lookup tables, per (ctx, token)
    and per ctx, whose rows hold one entry per model or pair. The first token
    of a text has nothing to be predicted from and counts 0 times.
    """
    entries = [(m, None) for m in models.names] if single else []
    entries += [(b, s) for b, s in pairs]
    by_context, by_token = _lookup_tables(models, entries, pairs, single)
    rows = counted.select(key, "ctx", "token", "n")
    spread = [key, "ctx", "token"]
    # A row of the tables is as long as the list of models and pairs.
    limit = BROADCAST_ENTRIES // len(entries)
    found = lookup_join(rows, by_token, ["ctx", "token"], "left", spread, limit)
    found = lookup_join(found, by_context, ["ctx"], "left", spread, limit)
    known = F.coalesce("token_stats", "context_stats", _unseen(models, entries))
    scored = F.when(F.col("ctx").isNull(), F.lit(0)).otherwise(F.col("n")).cast("bigint")
    return found.select(key, scored.alias("n"), F.inline(known)).select(
        F.col(key),
        "model",
        "model2",
        "n",
        "logprob",
        "entropy",
        "rank",
        "mu",
        "var",
        (-F.col("mu")).alias("xent"),
        F.lit(False).alias("is_pad"),
    )


def _unseen(models: BigramModels, entries: Sequence[tuple[str, str | None]]) -> Column:
    """Statistics in a context that no model has seen: the uniform distribution."""
    spread = F.log(F.lit(float(models.vocabulary_size)))
    nothing = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(second).cast("string").alias("model2"),
            (-spread).alias("logprob"),
            spread.alias("entropy"),
            F.lit(1.0).alias("rank"),
            (-spread if second else nothing).alias("mu"),
            (F.lit(0.0) if second else nothing).alias("var"),
        )
        for model, second in entries
    ]
    return F.array(*rows)


def _lookup_tables(models, entries, pairs, single):
    """The (ctx) and (ctx, token) tables of statistics, written to shared storage."""
    a, v = F.lit(float(models.alpha)), F.lit(float(models.vocabulary_size))
    nothing = F.lit(None).cast("double")
    parts = []
    if single:
        parts.append(
            single_statistics(models).select(
                "model", F.lit(None).cast("string").alias("model2"), "ctx", "n", "k", "entropy",
                nothing.alias("mu"), nothing.alias("var"),
            )
        )
    if pairs:
        parts.append(
            pair_statistics(models, pairs).select(
                "model", "model2", "ctx", "n", F.lit(None).cast("bigint").alias("k"),
                nothing.alias("entropy"), "mu", "var",
            )
        )
    stats = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # Every context with every entry; one the model has not seen is uniform.
    contexts = models.counts.select("ctx").distinct()
    grid = contexts.select("ctx", F.inline(_unseen(models, entries)))
    by = ["ctx", "model", "model2"]
    held = stats.select(
        "ctx", "model", F.coalesce("model2", F.lit("")).alias("second"), "n", "k",
        F.col("entropy").alias("e"), F.col("mu").alias("m"), F.col("var").alias("s"),
    )
    total = F.coalesce("n", F.lit(0)) + a * v
    full = materialize(
        grid.withColumn("second", F.coalesce("model2", F.lit("")))
        .join(held, ["ctx", "model", "second"], "left")
        .select(
            *by,
            total.alias("total"),
            F.log(a / total).alias("logprob"),
            F.coalesce("e", "entropy").alias("entropy"),
            (F.coalesce("k", F.lit(0)) + 1).cast("double").alias("rank"),
            F.coalesce("m", "mu").alias("mu"),
            F.coalesce("s", "var").alias("var"),
        ),
        "contexts",
    )
    fields = ["model", "model2", "logprob", "entropy", "rank", "mu", "var"]
    # A list holds one entry per model or pair.
    by_context = materialize(
        full.groupBy("ctx").agg(F.collect_list(F.struct(*fields)).alias("context_stats")), "by-context"
    )

    # Rank among the successors of a context; equal counts share the best rank.
    # A window holds the distinct counts of one context, however many successors it has.
    above = Window.partitionBy("model", "ctx").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    places = models.counts.groupBy("model", "ctx", "c").agg(F.count(F.lit(1)).alias("k"))
    places = places.withColumn("place", (F.coalesce(F.sum("k").over(above), F.lit(0)) + 1).cast("double")).drop("k")
    ranked = models.counts.join(places, ["model", "ctx", "c"]).select("ctx", "token", "model", "c", "place")
    by_token = materialize(
        models.counts.select("ctx", "token")
        .distinct()
        .join(full, "ctx")
        .join(ranked, ["ctx", "token", "model"], "left")
        .withColumn("logprob", F.log((F.coalesce("c", F.lit(0)) + a) / F.col("total")))
        .withColumn("rank", F.coalesce("place", "rank"))
        .groupBy("ctx", "token")
        .agg(F.collect_list(F.struct(*fields)).alias("token_stats")),
        "by-token",
    )
    return by_context, by_token
