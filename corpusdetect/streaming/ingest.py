"""Resumable and repeatable jobs over growing stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import sample_row_hash
from ..plans.joins import lookup_join
from ..plans.sketch import may_contain
from ..plans.storage import COMPACT, held, setting, shuffles_dropped
from ..schemas import SAMPLE_SCHEMA

# Folders of a store of unique samples: by so many digits of the hash.
PREFIX_DIGITS = 2
# Whether both sides of a join are dealt by all of its keys, or else by some of them.
_DEALT_ALIKE = "spark.sql.requireAllClusterKeysForCoPartition"
# Tasks that list a store's folders, and what opening a file counts when files are dealt to tasks: of many small files
# only hashes are read.
_LISTING, _OPENING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"
# What makes a detection row unique.
DETECTION_KEY = ("CodeSampleHash", "Detector", "BaseModel", "SecondaryModel")


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA, files_per_batch: int = 8
) -> DataFrame:
    """New files of a Parquet store as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Process what has arrived since the last run and append it to ``target``.

    The checkpoint remembers the position: after a crash the open batch is done
    again, and the file sink shows each batch once.
    """
    return (
        transform(source)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


def unique_samples(source: DataFrame, watermark: tuple[str, str]) -> DataFrame:
    """The first sample of every hash in a stream, as far as the watermark reaches.

    The watermark (event-time column, delay) bounds the state: hashes older than the delay are
    forgotten. :func:`append_unique` forgets none and keeps no state.
    """
    column, delay = watermark
    hashed = source.withColumn("hash", sample_row_hash())
    return hashed.withWatermark(column, delay).dropDuplicatesWithinWatermark(["hash"])


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """A name for all runs from one checkpoint, kept in its folder; a new checkpoint gets a new one.

    Batch numbers begin at 0 with every checkpoint, so a batch is known by both.
    """
    path = f"{checkpoint.rstrip('/')}/run"
    spark.createDataFrame([(uuid4().hex,)], "run string").coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("run string").parquet(path).first()["run"]


def _others(spark: SparkSession, target: str, run: str, number: int, fields: Sequence[T.StructField]) -> DataFrame | None:
    """These columns of what other batches have stored, or None before the first one.

    A repeated batch is not compared with itself. With the schema given, no file is opened to find it.
    """
    layout = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
    try:
        stored = spark.read.schema(T.StructType([*fields, *layout])).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.filter((F.col("run") != run) | (F.col("batch") != number))


def new_hashes(rows: DataFrame, stored: DataFrame | None, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Rows (with ``hash`` and its ``prefix``) whose hash ``stored`` lacks, dealt by prefix; only folders of their prefixes are opened."""
    placed = rows.repartition("prefix")
    if stored is None:
        return placed
    prefixes = [r["prefix"] for r in rows.select("prefix").distinct().collect()]  # no more than 16 ** digits
    if len(prefixes) < 16**digits:
        stored = stored.filter(F.col("prefix").isin(prefixes))
    # Spark would push an anti join below the deal, and shuffle the rows twice.
    known = stored.select("hash", "prefix", F.lit(True).alias("_known"))
    return placed.join(known, ["prefix", "hash"], "left").filter(F.col("_known").isNull()).drop("_known")


def append_unique(source: DataFrame, target: str, checkpoint: str, digits: int = PREFIX_DIGITS) -> StreamingQuery:
    """Append each sample whose hash the store does not hold yet.

    The store itself is the state. It is laid out by run, batch and the first ``digits`` of the hash, so a
    batch of few rows opens few folders, however large the store has become. Each batch has its own
    folder, replaced as a whole on repetition and left alone by runs from other checkpoints.
    """
    run = run_id(source.sparkSession, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        # A letter in front, so that no folder's name looks like a number.
        prefix = F.concat(F.lit("h"), F.substring("hash", 1, digits))
        hashed = batch.withColumn("hash", sample_row_hash()).withColumn("prefix", prefix)
        fields = [T.StructField("hash", T.StringType()), T.StructField("prefix", T.StringType())]
        folder = f"{target}/run={run}/batch={number}"
        # Texts that are dealt by prefix meet stored hashes, dealt alike, where they are.
        with (
            shuffles_dropped(own),
            setting(own, _DEALT_ALIKE, "false"),
            setting(own, _LISTING, str(own.sparkContext.defaultParallelism)),
            setting(own, _OPENING, str(256 * 1024)),
            held(hashed.dropDuplicates(["hash"]), "batch") as distinct,
        ):
            new = new_hashes(distinct, _others(own, target, run, number, fields), digits)
            new.write.mode("overwrite").option("compression", COMPACT).partitionBy("prefix").parquet(folder)

    return _each_batch(source, write, checkpoint)


def _each_batch(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def remaining(
    samples: DataFrame, done: DataFrame, row_hash: Column | None = None, sketch: DataFrame | None = None
) -> DataFrame:
    """Samples without a row in ``done`` (a column ``CodeSampleHash``).

    With a ``sketch`` of these hashes (:mod:`plans.sketch`) only samples that may be done are joined with
    them; all others are known to remain where they are read.
    """
    key = sample_row_hash() if row_hash is None else row_hash
    finished = done.select("CodeSampleHash").distinct()
    hashed = samples.withColumn("CodeSampleHash", key)
    if sketch is None:
        return lookup_join(hashed, finished, ["CodeSampleHash"], "left_anti").drop("CodeSampleHash")
    # Hashes only: which of those that may be done are. No text meets the list. Spark would push a semi join
    # below the sketch's.
    known = may_contain(hashed.select("CodeSampleHash"), sketch, "CodeSampleHash").join(finished, "CodeSampleHash").distinct()
    return lookup_join(hashed, known, ["CodeSampleHash"], "left_anti").drop("CodeSampleHash")


def not_yet_scored(rows: DataFrame, store: DataFrame, key: Sequence[str] = DETECTION_KEY) -> DataFrame:
    """Detection rows whose key is not stored yet; a missing second model is a value."""
    names = [f"_{k}" for k in key]
    keyed = rows.select("*", *[F.coalesce(F.col(k), F.lit("")).alias(n) for k, n in zip(key, names)])
    known = store.select(*[F.coalesce(F.col(k), F.lit("")).alias(n) for k, n in zip(key, names)])
    return lookup_join(keyed, known.distinct(), names, "left_anti").drop(*names)


def score_stream(
    source: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    key: Sequence[str] | None = None,
) -> StreamingQuery:
    """Append the scores of each row once, also when a batch is repeated or a checkpoint is lost.

    Rows whose ``key`` (columns of the source that the scores keep) is stored are not scored again.
    Without a key, scores that are stored in all columns are not stored twice. Each batch has its own folder.
    """
    run = run_id(source.sparkSession, checkpoint)

    def unstored(rows: DataFrame, on: Sequence[str], number: int) -> DataFrame:
        stored = _others(rows.sparkSession, target, run, number, [rows.schema[c] for c in on])
        return rows if stored is None else lookup_join(rows, stored.select(*on).distinct(), on, "left_anti")

    def write(batch: DataFrame, number: int) -> None:
        if key is not None:
            batch = unstored(batch, key, number)
        scores = score(batch)
        if key is None:
            scores = unstored(scores, scores.columns, number)
        scores.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return _each_batch(source, write, checkpoint)
