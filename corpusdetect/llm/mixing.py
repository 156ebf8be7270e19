"""Mixing sources to target weights by capped water-filling.

Sizes are words. Every source gets a share of all words in proportion to its weight; a share above
``max_epochs`` times the source's own words is clamped there and the excess goes to the other
sources by weight, again and again until none is above. A source is then taken whole as often as its
target allows, and once more in part: the documents that come first in a seeded order, up to the
point nearest the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fits_broadcast, global_index, materialize
from .common import WORD

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240229
# Sources whose rows are sent to every executor.
BROADCAST_SOURCES = 100_000
# The seeded order is a 60-bit number, looked at 12 bits at a time.
_STEP = 12


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def _order(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Water-filling over (source, source_size), one row per source; adds ``target``.

    Sources are numbered by code point, null last, and take the weights in turn. Only three sums per
    round come to the driver; there are no more rounds than sources that get clamped.
    """
    exact = "decimal(19,0)"
    ranked = global_index(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select(
        "source",
        "source_size",
        weight.cast(exact).alias("weight"),
        (F.col("source_size") * max_epochs).cast(exact).alias("cap"),
    )
    total = int(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, parts, clamped_before = total, 0, -1
    clamped = F.lit(False)
    while True:
        free = ranked.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
            F.count(F.when(clamped, 1)),
        ).first()
        if free[2] == clamped_before or not int(free[1]):
            break
        clamped_before, level, parts = free[2], total - int(free[0]), int(free[1])
        clamped = F.col("weight") * F.lit(level).cast(exact) > F.col("cap") * F.lit(parts).cast(exact)
    if not parts:
        return ranked.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    share = (F.col("weight") * F.lit(level).cast(exact)).cast("double") / F.lit(float(parts))
    return ranked.select(
        "source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def _crossing(sums: DataFrame, cell: str) -> DataFrame:
    """The cell of each source in which the running size reaches the quota, at its end or before."""
    upto = Window.partitionBy("source").orderBy(cell)
    return (
        sums.withColumn("_to", F.col("_base") + F.sum("_size").over(upto))
        .withColumn("_base", F.col("_to") - F.col("_size"))
        .where((F.col("_base") < F.col("_quota")) & (F.col("_quota") <= F.col("_to")))
        .drop("_size", "_to")
    )


def _cutoffs(narrow: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, _cut): documents up to _cut in the seeded order make up the source's part.

    Sums over 12 bits of the order find the cell in which the quota is met, sums over the next 12
    bits the cell inside that one; only what is left there is put in order. No window sees more than
    4,096 cells, or the documents of one cell in 16 million.
    """
    first = F.shiftright("_order", 60 - _STEP)
    second = F.shiftright("_order", 60 - 2 * _STEP)
    null_safe = lambda a, b, *more: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in ("source", *more)))

    one = narrow.groupBy("source", first.alias("_one")).agg(F.sum("size").alias("_size"))
    one = one.alias("a").join(quotas.alias("b"), null_safe("a", "b")).select("a.*", "b._quota")
    one = _crossing(one.withColumn("_base", F.lit(0).cast("bigint")), "_one")
    two = narrow.withColumn("_one", first).alias("a").join(one.alias("b"), null_safe("a", "b", "_one"))
    two = two.groupBy("a.source", "b._quota", "b._base", second.alias("_two")).agg(F.sum("size").alias("_size"))
    two = _crossing(two, "_two")
    last = narrow.withColumn("_two", second).alias("a").join(two.alias("b"), null_safe("a", "b", "_two"))
    last = last.groupBy("a.source", "b._quota", "b._base", "a._order").agg(F.sum("size").alias("_size"))
    to = F.col("_base") + F.sum("_size").over(Window.partitionBy("source").orderBy("_order"))
    inside = 2 * to - F.col("_size") <= 2 * F.col("_quota")
    floor = F.min(F.shiftleft(F.shiftright("_order", 60 - 2 * _STEP), 60 - 2 * _STEP)) - 1
    return (
        last.withColumn("_in", inside)
        .groupBy("source")
        .agg(F.coalesce(F.max(F.when(F.col("_in"), F.col("_order"))), floor).alias("_cut"))
    )


def decide(
    narrow: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """(source, source_size, target, _whole, _cut), one row per source, written: how often its documents are taken.

    ``narrow`` has source, size and _order of every document. Each is taken ``_whole`` times, and once
    more if its order is not above ``_cut``.
    """
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, max_epochs, weights), "mix-targets")
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)).cast("bigint")
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)))
    targets = targets.withColumn("_quota", F.col("target") - F.col("_whole") * F.col("source_size"))
    cuts = _cutoffs(narrow, targets.select("source", "_quota"))
    # No cell reaches the quota: it is nothing, or rounding has put it above all of the source.
    none = F.when(F.col("_quota") >= F.col("source_size"), F.lit(1 << 60)).otherwise(F.lit(-1))
    decided = (
        targets.alias("t")
        .join(cuts.alias("c"), F.expr("t.source <=> c.source"), "left")
        .select("t.source", "t.source_size", "t.target", "t._whole", F.coalesce(F.col("c._cut"), none).alias("_cut"))
    )
    return materialize(decided, "mix-decided")


def _small(decided: DataFrame) -> DataFrame:
    """One row per source goes to every executor, if there are not too many sources."""
    return F.broadcast(decided) if fits_broadcast(decided, BROADCAST_SOURCES) else decided


def _epochs(order: Column) -> Column:
    return F.col("s._whole") + (order <= F.col("s._cut")).cast("bigint")


def _narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    return materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(text_col).alias("size"),
            _order(F.col(id_col), seed).alias("_order"),
        ),
        "mix-sizes",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_epochs: int = MAX_EPOCHS,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken.

    ``epochs`` is how often the document is taken, ``taken`` its words times that. Null texts have
    size 0; a null source is a source of its own, the last; rows with the same id are taken or left
    together; an empty table gives no rows. Only id, source and size of the rows are ever moved. The
    order is a hash of seed and id, so reruns and retried tasks agree.
    """
    narrow = _narrow(docs, id_col, source_col, text_col, seed)
    decided = _small(decide(narrow, max_epochs, weights))
    return (
        narrow.alias("n")
        .join(decided.alias("s"), F.expr("n.source <=> s.source"))
        .select("n.doc_id", "n.source", "n.size", "s.source_size", "s.target", _epochs(F.col("n._order")).alias("epochs"))
        .withColumn("taken", F.col("size") * F.col("epochs"))
    )


def repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_epochs: int = MAX_EPOCHS,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged.

    What a row gets follows from its id and its source's row, so texts are read and not shuffled.
    """
    decided = _small(decide(_narrow(docs, id_col, source_col, text_col, seed), max_epochs, weights))
    # The row as one struct, whatever its columns are called.
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("source"), _order(F.col(id_col), seed).alias("_order")
    )
    met = rows.alias("n").join(decided.alias("s"), F.expr("n.source <=> s.source"))
    taken = met.select("n.row", _epochs(F.col("n._order")).alias("epochs")).where("epochs > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)), 1, 15))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST) AS n FROM s
), c AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
              ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
  FROM o
), level AS (
  SELECT num, den FROM c WHERE w * num <= 3 * source_size * den ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN w * l.num > 3 * source_size * l.den THEN (3 * source_size)::DOUBLE
                                   ELSE (w * l.num)::DOUBLE / l.den::DOUBLE END AS target
  FROM s CROSS JOIN level l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size::DOUBLE), 3)::BIGINT ELSE 0 END AS whole
  FROM t
), r AS (
  SELECT d.doc_id, d.size, q.source_size::BIGINT AS source_size, q.target, q.whole,
         q.target - q.whole * q.source_size::DOUBLE AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY u) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, u) AS tied
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN (2 * upto - tied)::DOUBLE <= 2 * quota THEN 1 ELSE 0 END)::BIGINT AS taken
FROM r
"""
