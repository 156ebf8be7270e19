"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import materialize

# Edges that a task contracts at once.
EDGES = 200_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the vertices 0 to n - 1 the least one that edges (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(id, root) of every vertex of edges (a, b, hash of a, hash of b)."""
    table = pa.Table.from_batches(held)
    coded = pa.concat_arrays(table["a"].chunks + table["b"].chunks).dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(coded.dictionary)
    hashes = np.empty(n, dtype=np.int64)
    hashes[codes] = np.concatenate([table["_a"].to_numpy(), table["_b"].to_numpy()])
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    a, b = rank[codes].reshape(2, -1)
    ids = coded.dictionary.take(pa.array(order))
    return pa.record_batch([ids, ids.take(pa.array(roots(a, b, n)))], names=["id", "root"])


def _contracted(edges: DataFrame) -> DataFrame:
    """(id, root): every vertex of a task's edges with the first, by hash, of those they connect it with."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield _stars(held)
                held, n = [], 0
        if n:
            yield _stars(held)

    hashed = edges.where("a <> b").select("a", "b", F.xxhash64("a").alias("_a"), F.xxhash64("b").alias("_b"))
    return hashed.mapInArrow(run, f"id {kind}, root {kind}")


def clusters(edges: DataFrame) -> DataFrame:
    """(id, component): every end of an edge (a, b) with one of the vertices it is connected with, the same for all these.

    Every round contracts edges within tasks first, which needs no shuffle; then each vertex is named by
    the first, by hash, of itself and what its tasks found, and edges between different names stay. The
    order by hash makes rounds few whatever the order of ids along a chain. Names are then resolved from
    the last round back. A round is an aggregate and two joins on single vertices; its tables are
    written, so a lost executor costs a re-read.
    """
    spark = edges.sparkSession
    left = materialize(_contracted(edges), "edges")
    rounds = []
    while not left.isEmpty():
        names = left.groupBy("id").agg(F.min_by("root", F.xxhash64("root")).alias("name"))
        names = materialize(names, "names")
        rounds.append(names)
        first = names.select("id", F.col("name").alias("a"))
        second = names.select(F.col("id").alias("root"), F.col("name").alias("b"))
        renamed = left.where("id <> root").join(first, "id").join(second, "root").select("a", "b")
        left = materialize(_contracted(renamed), "edges")
    if not rounds:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, component {kind}")
    found = rounds[-1].withColumnRenamed("name", "component")
    for names in reversed(rounds[:-1]):
        later = found.select(F.col("id").alias("name"), "component")
        found = names.join(later, "name", "left").select(
            "id", F.coalesce("component", "name").alias("component")
        )
        found = materialize(found, "components")
    return found


def merged(found: DataFrame, later: DataFrame) -> DataFrame:
    """Clusters ``found`` after those of ``later``, whose ids are components of ``found`` or vertices it lacks."""
    names = later.select(F.col("id").alias("component"), F.col("component").alias("_name"))
    joined = found.join(names, "component", "left").select("id", F.coalesce("_name", "component").alias("component"))
    new = later.join(found.where("id = component").select("id"), "id", "left_anti").select("id", "component")
    return materialize(joined.union(new), "components")


def by_least(found: DataFrame) -> DataFrame:
    """The same clusters, each named by its least id."""
    least = found.groupBy("component").agg(F.min("id").alias("_least"))
    return materialize(found.join(least, "component").select("id", F.col("_least").alias("component")), "components")
