"""Approximate nearest neighbours by low-dimensional stable projections.

Unit vectors are projected on a few Gaussian directions (a 2-stable projection). For a pair at
distance d, the squared projected distance over d² follows a chi-square law with one degree of
freedom per direction. Neighbours in the projection are met in order of growing projected distance,
from a kd-tree, and verified with the original vectors; the search stops once the law says that a
vector better than the k-th verified one would have been met with the chosen probability.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import materialize
from .blocks import best, distinct_values, search_in_blocks
from .hamming import usable

K = 5
PROJECTED = 8
CONFIDENCE = 0.98
SEED = 17
LEAF = 64
ITEM_BLOCK = 1 << 14
QUERY_BLOCK = 1024
_FOUND = "query_id bigint, vec_id bigint, score double"


def chi_square_cdf(x: float, freedom: int) -> float:
    """Regularised lower incomplete gamma function of (freedom / 2, x / 2), by its series."""
    a, z = freedom / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = math.exp(-z + a * math.log(z) - math.lgamma(a + 1))
    n = a
    while term > 1e-15 * total:
        n += 1
        term *= z / n
        total += term
    return min(total, 1.0)


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, freedom) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high


class KdTree:
    """Points split at medians of their widest axis; leaves are runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int] | None] = []
        self.runs: list[tuple[int, int]] = []
        pending = [(0, len(points), self._node())]
        while pending:
            start, end, node = pending.pop()
            own = points[self.order[start:end]]
            self.boxes[node] = (own.min(axis=0), own.max(axis=0))
            self.runs[node] = (start, end)
            axis = int(np.argmax(self.boxes[node][1] - self.boxes[node][0]))
            if end - start <= leaf or self.boxes[node][0][axis] == self.boxes[node][1][axis]:
                continue
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], half)]
            self.children[node] = (self._node(), self._node())
            pending.append((start, start + half, self.children[node][0]))
            pending.append((start + half, end, self.children[node][1]))
        self.low = np.array([b[0] for b in self.boxes])
        self.high = np.array([b[1] for b in self.boxes])

    def _node(self) -> int:
        for x in (self.boxes, self.children, self.runs):
            x.append(None)
        return len(self.boxes) - 1

    def nearest_leaves(self, query: np.ndarray):
        """(squared distance of the box, start, end) of the leaves, nearest box first."""
        gaps = np.maximum(np.maximum(self.low - query, query - self.high), 0.0)
        apart = (gaps * gaps).sum(axis=1).tolist()
        heap = [(apart[0], 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            if self.children[node] is None:
                yield (distance, *self.runs[node])
                continue
            for child in self.children[node]:
                heapq.heappush(heap, (apart[child], child))


def _search(k: int, projected: int, confidence: float, seed: int):
    reach = chi_square_quantile(confidence, projected)

    def matrix(column, dim: int) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(-1, dim)

    def measured(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and their norms; those whose squares would vanish or overflow are scaled first."""
        with np.errstate(over="ignore"):
            norms = np.sqrt((vectors * vectors).sum(axis=1))
        odd = (norms < 1e-140) | ~np.isfinite(norms)
        if odd.any():
            vectors = vectors.copy()
            vectors[odd] /= np.abs(vectors[odd]).max(axis=1, keepdims=True)
            norms[odd] = np.sqrt((vectors[odd] * vectors[odd]).sum(axis=1))
        return vectors, norms

    def search(items: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if items.num_rows and queries.num_rows:
            dim = items.column("dim")[0].as_py()
            original, norms = measured(matrix(items.column("value"), dim))
            unit = original / norms[:, None]
            directions = np.random.default_rng([seed, dim]).standard_normal((dim, projected))
            tree = KdTree(unit @ directions)
            original, norms, unit = original[tree.order], norms[tree.order], unit[tree.order]
            listed = items.column("ids").to_pylist()
            ids = [listed[i] for i in tree.order]
            asking, sizes = measured(matrix(queries.column("value"), dim))
            for own, asked, size in zip(queries.column("query_id").to_pylist(), asking, sizes.tolist(), strict=True):
                direction = asked / size
                kept: list[tuple[float, int, int]] = []  # smallest score first, then largest id
                for box, start, end in tree.nearest_leaves(direction @ directions):
                    if len(kept) == k and box > reach * max(0.0, 2 - 2 * kept[0][0]) + 1e-9:
                        break
                    scores = unit[start:end] @ direction
                    least = kept[0][0] - 1e-9 if len(kept) == k else -2.0
                    for at in np.flatnonzero(scores >= least):
                        at = start + int(at)
                        score = float((original[at] * asked).sum()) / (float(norms[at]) * size)
                        for i in ids[at]:
                            if i == own:
                                continue
                            if len(kept) < k:
                                heapq.heappush(kept, (score, -i, at))
                            elif (score, -i) > kept[0][:2]:
                                heapq.heapreplace(kept, (score, -i, at))
                for score, minus, _ in kept:
                    out[0].append(own)
                    out[1].append(-minus)
                    out[2].append(score)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return search


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    projected: int = PROJECTED,
    confidence: float = CONFIDENCE,
    seed: int = SEED,
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found nearest by cosine, nearest first.

    Scores are computed from the original vectors in double precision; ties go to the smaller id. A
    row is no neighbour of queries with its own id. Vectors that are null, empty, zero or hold null
    or non-finite components, and rows without an id, take no part; only vectors of equal length
    meet; repeated rows count once. All candidates come back where there are fewer than k. Each true
    neighbour is met with at least ``confidence``.
    """

    def usable_rows(rows: DataFrame) -> DataFrame:
        chosen = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("value"))
        zero = F.forall("value", lambda x: x == 0)
        return chosen.where(F.col("id").isNotNull() & usable(F.col("value")) & ~zero)

    items = distinct_values(usable_rows(vectors), "id", "value", k + 1).withColumn("dim", F.size("value"))
    asked = usable_rows(queries).select(F.col("id").alias("query_id"), "value", F.size("value").alias("dim"))
    items, asked = materialize(items, "vectors"), materialize(asked.distinct(), "vector-queries")
    found = search_in_blocks(
        items,
        asked,
        _search(k, projected, confidence, seed),
        _FOUND,
        items.count(),
        asked.count(),
        item_block,
        query_block,
    )
    return best(found.distinct(), "score", True, k, "vec_id").select("query_id", "rank", "vec_id", "score")
