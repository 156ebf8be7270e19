"""What the operators of this folder share: session settings, reading, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Bounds of a batch that Spark hands to Python: few rows, as one text may be very long.
BATCH_ROWS = 512
BATCH_BYTES = 8 * 1024 * 1024
# One row in this many is held out from learning.
FOLDS = 5


def tune(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python workers, whatever the rows' sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def below_rate(key: Column, rate: float, seed: int) -> Column:
    """A repeatable sample: whether the key's hash lies in the first ``rate`` of all hashes."""
    steps = 1 << 52
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 12)
    return place < F.lit(int(min(1.0, max(0.0, rate)) * steps))
