"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments, each with a table from segment value to codes. A query looks up the
segment values within radius 0, 1, 2 … of its own, one segment after the other. After the lookups of
radius r in segments 0…j of s, every code within distance s·r + j has been met: one that has not
differs by at least r + 1 bits in those segments and by r bits in the others. The search ends when
the k-th verified distance is covered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import materialize
from .blocks import best, distinct_values, search_in_blocks

K = 5
ITEM_BLOCK = 1 << 17
QUERY_BLOCK = 2048
_FOUND = "query_id bigint, vec_id bigint, distance int"


def usable(vector: Column) -> Column:
    """Vectors that are not null or empty and whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, code): bit i tells whether component i is positive; most significant bit first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False) > 0
            ends = np.cumsum(lengths)
            codes = [np.packbits(flat[e - n : e]).tobytes() for e, n in zip(ends, lengths, strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array(lengths, pa.int32()), pa.array(codes, pa.binary())],
                names=["id", "dim", "code"],
            )

    chosen = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    return chosen.where(usable(F.col("v")) & F.col("id").isNotNull()).mapInArrow(
        pack, "id bigint, dim int, code binary"
    )


@lru_cache(maxsize=256)
def _masks(bits: int, radius: int) -> np.ndarray:
    """All segment values with that many bits."""
    sums = [sum(1 << i for i in chosen) for chosen in combinations(range(bits), radius)]
    return np.array(sums, dtype=np.int64)


class MultiIndex:
    """The segment tables of one block of distinct codes (rows of bits)."""

    def __init__(self, bits: np.ndarray):
        n, dim = bits.shape
        width = min(16, max(4, round(math.log2(max(n, 2)))))
        self.cuts = np.array_split(np.arange(dim), max(1, math.ceil(dim / width)))
        self.packed = np.packbits(bits, axis=1)
        self.n = n
        self.tables = []
        for cut in self.cuts:
            values = self._value(bits, cut)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << len(cut)) + 1))))

    @staticmethod
    def _value(bits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return bits[:, cut].astype(np.int64) @ (1 << np.arange(len(cut), dtype=np.int64))

    def search(self, query: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distances) met until ``enough(distances, codes, covered)``."""
        met = np.zeros(self.n, dtype=bool)
        packed = np.packbits(query)
        values = [int(self._value(query[None, :], cut)[0]) for cut in self.cuts]
        codes, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        s = len(self.cuts)
        for radius in range(max(map(len, self.cuts)) + 1):
            for j, (cut, (order, starts)) in enumerate(zip(self.cuts, self.tables, strict=True)):
                if radius <= len(cut):
                    buckets = values[j] ^ _masks(len(cut), radius)
                    first, sizes = starts[buckets], starts[buckets + 1] - starts[buckets]
                    full = sizes > 0
                    first, sizes = first[full], sizes[full]
                    places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    new = order[places]
                    new = new[~met[new]]
                    met[new] = True
                    codes = np.concatenate([codes, new])
                    apart = np.bitwise_count(self.packed[new] ^ packed).sum(axis=1, dtype=np.int64)
                    distances = np.concatenate([distances, apart])
                if len(codes) == self.n or enough(distances, codes, s * radius + j):
                    return codes, distances
        return codes, distances


def _search(k: int):
    def search(items: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if items.num_rows and queries.num_rows:
            dim = items.column("dim")[0].as_py()

            def bits(column) -> np.ndarray:
                raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
                return np.unpackbits(raw.reshape(len(column), -1), axis=1)[:, :dim]

            index = MultiIndex(bits(items.column("value")))
            ids = items.column("ids").to_pylist()
            counts = np.array([len(x) for x in ids])

            def enough(distances, codes, covered):
                near = distances <= covered
                # One id of all may be the query's own.
                return near.any() and counts[codes[near]].sum() > k

            for own, query in zip(queries.column("query_id").to_pylist(), bits(queries.column("value")), strict=True):
                codes, distances = index.search(query, enough)
                order = np.argsort(distances, kind="stable")
                limit, rows = None, []
                for at in order:
                    if limit is not None and distances[at] > limit:
                        break
                    rows += [(int(distances[at]), i) for i in ids[codes[at]] if i != own]
                    if limit is None and len(rows) >= k:
                        limit = distances[at]
                for distance, i in sorted(rows)[:k]:
                    out[0].append(own)
                    out[1].append(i)
                    out[2].append(distance)
        kinds = (pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "distance"])

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k codes nearest each query's sign code, exactly.

    A row is no neighbour of queries with its own id; ties go to the smaller id; fewer than k rows
    come back when there are fewer candidates. Vectors that are null, empty or hold null or
    non-finite components, and rows without an id, take no part; only vectors of equal length meet;
    repeated rows count once; an empty table gives no rows.
    """
    items = sign_codes(vectors, id_col, vector_col).withColumn("value", F.struct("dim", "code"))
    items = distinct_values(items, "id", "value", k + 1).select(
        F.col("value.dim").alias("dim"), F.col("value.code").alias("value"), "ids"
    )
    asked = sign_codes(queries, id_col, vector_col).selectExpr("id AS query_id", "dim", "code AS value").distinct()
    items, asked = materialize(items, "codes"), materialize(asked, "code-queries")
    found = search_in_blocks(
        items, asked, _search(k), _FOUND, items.count(), asked.count(), item_block, query_block
    )
    return best(found.distinct(), "distance", False, k, "vec_id").select("query_id", "rank", "vec_id", "distance")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS code FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.code, v.code), lambda z: (z[1] <> z[2])::INT))::INT AS distance
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.code) = len(v.code)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p
) WHERE rank <= 5
"""
