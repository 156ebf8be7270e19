"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Takes two thirds of the room that Spark's usual one takes for texts.
COMPACT = "zstd"
# Parts of a large input that are worked on one after the other.
SLICES = 6

_LOCAL_FOLDERS: dict[str, str] = {}
_SCRATCH: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets one
    temporary folder of its own. A cluster session without it is an error, as
    a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="corpusdetect-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def _delete(paths: list[str]) -> int:
    from pyarrow import fs

    for path in paths:
        system, name = fs.FileSystem.from_uri(path)
        if system.get_file_info(name).type != fs.FileType.NotFound:
            system.delete_dir(name)
    return len(paths)


def drop_scratch() -> int:
    """Delete the intermediate tables that this process has written, when nothing reads them any more.

    Returns how many paths there were.
    """
    paths, _SCRATCH[:] = list(_SCRATCH), []
    return _delete(paths)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete what is written to the shared folder inside, at the end: results must be stored or collected by then.

    Scopes may lie in one another; one thread makes them.
    """
    before = len(_SCRATCH)
    try:
        yield
    finally:
        own, _SCRATCH[before:] = _SCRATCH[before:], []
        _delete(own)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Inside, what a job has shuffled is deleted when the job ends, and not when the driver collects its garbage.

    For jobs that write: a table that is collected twice would be shuffled twice.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def empty_folder(path: str) -> None:
    """Delete the files of a folder, which stays."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.delete_dir_contents(name)


@contextmanager
def held(df: DataFrame, label: str = "table") -> Iterator[DataFrame]:
    """:func:`materialize` for texts that are needed inside only; they are deleted at the end."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        df.write.option("compression", COMPACT).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete([path])
        if path in _SCRATCH:
            _SCRATCH.remove(path)


def slices(df: DataFrame, key: Column, most: int = SLICES) -> list[DataFrame]:
    """``df`` cut by a hash of ``key``; what is made of a slice can be deleted before the next one is read.

    No more slices than partitions: small inputs are left whole. Each slice reads the input again.
    """
    parts = min(most, df.rdd.getNumPartitions())
    return [df.filter(_slice(key, parts) == i) for i in range(parts)] if parts > 1 else [df]


def _slice(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def materialize(df: DataFrame, label: str = "table", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    Cuts the lineage so that a lost executor re-reads files instead of
    recomputing, pins every non-deterministic choice made upstream, and gives
    the planner true sizes for its join choices. ``rows_per_file`` bounds files of
    rows that take little room but much work: Spark counts a file as 4 MB at least
    when it deals files to tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that multiplies its rows.

    A small file is read in a single task, whatever is done with its rows
    afterwards. Inputs that fill the cores with scan tasks are left alone, as
    shuffling whole texts would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parts_for(df: DataFrame, least: int) -> int:
    """A multiple of ``least``, at least as many as ``df`` has partitions: parts that do not grow with the input."""
    return least * max(1, -(-df.rdd.getNumPartitions() // least))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Partition by ``key``, so that later groupings that include it need no shuffle.

    Meant for rows that are about to multiply: moving texts once is far cheaper
    than moving what they are taken apart into. The key must be (nearly) unique.
    The number of tasks is the session's shuffle setting, at least one per core;
    a planner's estimate would be useless for derived inputs.
    """
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, shuffled), key)
