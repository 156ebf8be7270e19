"""How filters that are applied one after the other interact, by folds in higher-order SQL functions.

Every document fails some set of filters, its mask. Documents are counted by part, mask and labels; such a
cell is folded across the array of all filter orders, which is a literal of the plan: along an order, the
first filter of the mask removes the cell, later filters of the mask are redundant there. A cell so gives
one struct for each step of each order, weighted by its counts, and the structs of a part's cells are
summed element by element. Only the counting sees the documents; the folds see at most 2 ** filters cells
a part and label.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import materialize
from .common import WORD

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
MARKS = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text: letter -> whether the text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n_words,
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``; an id with several label rows has what any of them says."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # Rows without an id have no labels; left out, they are no hot key.
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    without = rows.where("doc_id IS NULL").withColumns({c: F.lit(False) for c in ("good", "toxic")})
    return known.unionByName(without)


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail which filters; bit i is the i-th letter.

    ``filters`` are conditions on the column ``text``, by letter in order; the bit after theirs says that
    the text is that of a row with a smaller id. Null texts are empty, a null source is the part
    "", a null id is smaller or larger than none. Copies have the other filters' bits in common, so copies
    are settled by counts: of a text's rows with an id, all fail but those with the least id. Texts are
    known by their SHA-256; rows are reduced in each task first, so no text, part or id is a hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions = text_filters(F.col("text")) if filters is None else filters
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(conditions.values())]
    narrow = docs.select(
        F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # One row per id, text and part; written, as the word counts are dear and two plans below read it.
    rows = narrow.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = _labelled(materialize(rows, "masks"), labels)
    one = ["part", "mask", "good", "toxic"]
    texts = rows.groupBy("digest", *one).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min("doc_id").alias("least"),
        # The copies of a row are one row here, so the least id of a text, part and label has one count.
        F.min_by("n", "doc_id").alias("n_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    fails = F.col("with_id") - F.when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0))
    split = texts.withColumn("again", fails).select(
        *[c for c in one if c != "mask"],
        F.inline(
            F.array(
                F.struct(F.col("mask"), (F.col("n") - F.col("again")).alias("n")),
                F.struct((F.col("mask") + (1 << len(bits))).alias("mask"), F.col("again").alias("n")),
            )
        ),
    )
    return split.groupBy(*one).agg(F.sum("n").alias("n"))


def filter_orders(letters: str) -> Column:
    """All orders of the letters, as an array literal of (filter_order, its filters' bits)."""
    return F.array(
        *[
            F.struct(
                F.lit("".join(order)).alias("filter_order"),
                F.array(*[F.lit(1 << letters.index(x)) for x in order]).alias("bits"),
            )
            for order in permutations(letters)
        ]
    )


def fold(counted: DataFrame, letters: str) -> DataFrame:
    """(part, mask, steps): each cell folded across all orders, one weighted struct a step."""
    zero = F.lit(0).cast("bigint")
    n, good, toxic = F.col("n"), F.when(F.col("good"), F.col("n")).otherwise(zero), F.when(F.col("toxic"), F.col("n")).otherwise(zero)
    empty = F.array().cast(
        "array<struct<filter_order:string,step:int,bit:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    )

    def along(order: Column) -> Column:
        def step(state: Column, bit: Column) -> Column:
            hit = F.col("mask").bitwiseAND(bit) != 0
            stays = state["alive"] & ~hit
            removed = state["alive"] & hit
            weight = lambda condition, count: F.when(condition, count).otherwise(zero)
            one = F.struct(
                order["filter_order"].alias("filter_order"),
                (F.size(state["steps"]) + 1).alias("step"),
                bit.alias("bit"),
                weight(stays, n).alias("kept"),
                weight(removed, n).alias("removed"),
                weight(~state["alive"] & hit, n).alias("redundant"),
                weight(removed, good).alias("good_lost"),
                weight(removed, toxic).alias("toxic_lost"),
            )
            return F.struct(stays.alias("alive"), F.concat(state["steps"], F.array(one)).alias("steps"))

        start = F.struct(F.lit(True).alias("alive"), empty.alias("steps"))
        return F.aggregate(order["bits"], start, step, lambda state: state["steps"])

    return counted.select("part", "mask", "n", F.flatten(F.transform(filter_orders(letters), along)).alias("steps"))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    repeated: str = "E",
) -> DataFrame:
    """One row per part, order and step, zeros included: what the step's filter does there.

    Columns: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the filter's removed, summed over all orders). Parts are the sources of
    ``docs``, a null source and "" are one part; labels of unknown documents count for nothing; an
    empty table gives no rows.
    """
    letters = "".join(text_filters(F.col("text")) if filters is None else filters) + repeated
    counted = materialize(cells(docs, labels, filters), "cells")
    steps = fold(counted, letters).select("part", "mask", "n", F.inline("steps")).groupBy("part", "filter_order", "step", "bit").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(F.lit(0))).alias("unique_fails"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "bit"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return steps.withColumn("shapley", total).select(
        "part", "filter_order", "step", letter.alias("filter"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part,
         len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM w
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n,
         count(*) FILTER (coalesce(l.good, false)) AS good, count(*) FILTER (coalesce(l.toxic, false)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), x AS (SELECT unnest([1, 2, 3, 4, 5]) AS f
), o AS (
  SELECT [x1.f, x2.f, x3.f, x4.f, x5.f] AS fs FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.f, x2.f, x3.f, x4.f, x5.f])) = 5
), s AS (
  SELECT part, fails, n, good, toxic, fs, step::INTEGER AS step, fails[fs[step]] AS hit, fs[step] AS f,
         len(list_filter(fs[:step - 1], lambda i: fails[i])) > 0 AS before
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, array_to_string(list_transform(fs, lambda i: 'ABCDE'[i]), '') AS filter_order, step, 'ABCDE'[f] AS filter,
         coalesce(sum(n) FILTER (NOT before AND NOT hit), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT before AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (before AND hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (hit AND len(list_filter(fails, lambda y: y)) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT before AND hit), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT before AND hit), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
