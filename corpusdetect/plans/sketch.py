"""Bloom sketches of hash lists: what surely is not in a list needs no join with it.

A sketch is a table of blocks of 4,096 bits; a value sets PROBES bits of one block. It is made in one
aggregation, written beside the list it describes, merged with others by OR, and applied in the scan of the
other side: only rows that may be in the list go on to the exact join.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import fits_broadcast

WORDS = 64
PROBES = 5
# At ten bits a value and five probes about one foreign value in a hundred passes.
VALUES_PER_BLOCK = WORDS * 64 // 10
# Blocks of 512 bytes sent to every executor: 32 MB.
BROADCAST_BLOCKS = 65_536


def blocks_for(values: int) -> int:
    """Blocks of a sketch that is to hold so many values."""
    return max(1, ceil(values / VALUES_PER_BLOCK))


def _block(value: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks) if isinstance(blocks, int) else blocks)


def _places(value: Column) -> list[Column]:
    """The bits of a block, as numbers below 4,096, that a value sets."""
    spread = F.xxhash64(value, F.lit(1))
    return [F.shiftrightunsigned(spread, 12 * i).bitwiseAND(F.lit(WORDS * 64 - 1)) for i in range(PROBES)]


def _together(words: DataFrame) -> DataFrame:
    """(blocks, block, bits) of rows (blocks, block, word, part)."""
    summed = words.groupBy("blocks", "block", "word").agg(F.bit_or("part").alias("part"))
    found = F.map_from_entries(F.collect_list(F.struct("word", "part")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("found")[i], F.lit(0).cast("bigint")))
    return summed.groupBy("blocks", "block").agg(found.alias("found")).select("blocks", "block", dense.alias("bits"))


def bloom_sketch(values: DataFrame, column: str, blocks: int) -> DataFrame:
    """(blocks, block, bits) of all values of a column; nulls are in no sketch."""
    places = values.where(F.col(column).isNotNull()).select(
        F.lit(blocks).cast("bigint").alias("blocks"),
        _block(F.col(column), blocks).alias("block"),
        F.explode(F.array(*_places(F.col(column)))).alias("place"),
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    return _together(
        places.select("blocks", "block", F.shiftright("place", 6).cast("int").alias("word"), bit.alias("part"))
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The sketch of all values of several, which have the same number of blocks."""
    words = sketches.select("blocks", "block", F.posexplode("bits").alias("word", "part"))
    return _together(words.where("part <> 0"))


def write_sketch(values: DataFrame, column: str, path: str, blocks: int) -> None:
    """Add the sketch of further values to those at ``path``."""
    bloom_sketch(values, column, blocks).write.mode("append").parquet(path)


def read_sketch(spark: SparkSession, path: str) -> DataFrame:
    sketch = spark.read.parquet(path)
    # Pieces of several writes are merged; a single piece has each block once already.
    return merged_sketches(sketch)


def may_contain(rows: DataFrame, sketch: DataFrame, column: str) -> DataFrame:
    """The rows whose value may be in the sketched list; none that is in it is missing.

    The sketch goes to every executor if it has at most BROADCAST_BLOCKS blocks, so rows are tested where
    they are read. A larger one is met by block. An empty sketch has no rows and lets none pass.
    """
    blocks = sketch.select("blocks").first()
    if blocks is None:
        return rows.limit(0)
    small = sketch.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    if fits_broadcast(small.select("_block"), BROADCAST_BLOCKS):
        small = F.broadcast(small)
    met = rows.withColumn("_block", _block(F.col(column), int(blocks[0]))).join(small, "_block")
    for place in _places(F.col(column)):
        word = F.element_at("_bits", (F.shiftright(place, 6) + 1).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
        met = met.where(word.bitwiseAND(bit) != 0)
    return met.select(*rows.columns)
