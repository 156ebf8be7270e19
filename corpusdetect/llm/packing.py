"""Packing documents into sequences: dominance reduction, then best fit.

A piece is no longer than a sequence, so the whole instance is the number of pieces of each length:
a few numbers, whatever the size of the corpus. They are planned on the driver. Sets that dominate
every other set with the same piece are fixed for good (Martello and Toth): a piece that nothing fits
beside, a piece with one that fills the sequence exactly, a piece with the longest that fits if no
shorter ones together take more. What is left is packed best-fit, longest first. A plan is a list of
runs: that many pieces of one length go, so many to a sequence, to consecutive sequences at one place.
The pieces find their run by their number among the pieces of their length.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import materialize
from .wordids import word_ids

CAPACITY = 1024
END_ID = 2


class Plan:
    """Runs of pieces: (length, first number, pieces, to a sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self._used = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.reduced = 0
        self._reduce()
        self._best_fit()

    def _put(self, length: int, n: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self._used[length]), n, each, sequence, offset))
        self._used[length] += n
        self.left[length] -= n

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _longest(self, most: int) -> int:
        """The longest length still there of at most ``most``; 0 if none."""
        there = np.flatnonzero(self.left[1 : most + 1])
        return int(there[-1]) + 1 if len(there) else 0

    def _best_pair(self, room: int) -> tuple[int, int]:
        """The largest sum of two pieces that fits, and the least sum of three."""
        lengths = np.flatnonzero(self.left)
        smallest = np.repeat(lengths, np.minimum(self.left[lengths], 3))[:3]
        three = int(smallest.sum()) if len(smallest) == 3 else self.capacity + 1
        best = 0
        for a in lengths[lengths < room]:
            self.left[a] -= 1
            b = self._longest(min(int(a), room - int(a)))
            self.left[a] += 1
            if b:
                best = max(best, int(a) + b)
        return best, three

    def _partner(self, length: int) -> int | None:
        """What dominates beside a piece of this length: 0 for nothing, None if not settled."""
        room = self.capacity - length
        self.left[length] -= 1
        try:
            single = self._longest(room)
            if single == room or not single:
                return single
            pair, three = self._best_pair(room)
            return single if three > room and single >= pair else None
        finally:
            self.left[length] += 1

    def _reduce(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                partner = self._partner(length)
                if partner is None:
                    break
                if not partner:
                    n = int(self.left[length])
                    if 2 * length <= self.capacity:
                        n = 1
                    self._put(length, n, 1, self._open(n), 0)
                elif partner == length:
                    n = int(self.left[length]) // 2
                    self._put(length, 2 * n, 2, self._open(n), 0)
                else:
                    n = int(min(self.left[length], self.left[partner]))
                    first = self._open(n)
                    self._put(length, n, 1, first, 0)
                    self._put(partner, n, 1, first, length)
        self.reduced = self.sequences

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, sequences)
        open_ = np.zeros(self.capacity + 1, dtype=bool)

        def keep(free: int, first: int, n: int) -> None:
            if free and n:
                room[free].append((first, n))
                open_[free] = True

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                fits = np.flatnonzero(open_[length:])
                free = length + int(fits[0]) if len(fits) else self.capacity
                each = min(free // length, n)
                if len(fits):
                    first, there = room[free].pop()
                    open_[free] = bool(room[free])
                else:
                    there = n // each
                    first = self._open(there)
                filled = min(there, n // each)
                self._put(length, filled * each, each, first, self.capacity - free)
                keep(free - each * length, first, filled)
                keep(free, first + filled, there - filled)

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted run keys (length and first number in one) and the runs in that order."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)
        return (runs[:, 0] << 48) + runs[:, 1], runs


def cut(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, numbered among the pieces of its length in its task."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _within bigint"
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer), struct.pack("<I", end_id)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for at, ids in enumerate(encoder.ids(texts)):
                ids += end
                total = len(ids) // 4
                start, stop = 0, total % capacity or capacity
                piece = 0
                while start < total:
                    length = stop - start
                    rows.append((at, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), seen[length]))
                    seen[length] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            table = np.array(rows, dtype=np.int64).reshape(-1, 6)
            columns = [
                batch.column(0).take(pa.array(table[:, 0])),
                pa.array(table[:, 1], pa.int32()),
                *(pa.array(table[:, i]) for i in (2, 3, 4)),
                pa.array(np.full(len(table), task, dtype=np.int32)),
                pa.array(table[:, 5]),
            ]
            yield pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than a sequence is cut, into full
    sequences and what is over, which comes first. Null and empty texts are one token. Null ids and
    repeated rows are packed like all others, each row by itself; an empty table gives no rows. The
    pieces are written once, so retried tasks cannot change the numbers that the plan relies on.
    """
    pieces = materialize(cut(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    by_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per length and task; a window sees the tasks of one length.
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = materialize(
        by_task.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "piece-counts"
    )
    counts = by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most ``capacity`` rows
    keys, runs = Plan({r["length"]: r["n"] for r in counts}, capacity).lookup()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            number = batch.column(5).to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
            inside = number - run[:, 1]
            sequence = run[:, 4] + inside // run[:, 3]
            offset = run[:, 5] + inside % run[:, 3] * length
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    numbered = pieces.join(by_task.select("length", "_task", "_first"), ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_within")).alias("_number")
    )
    return numbered.mapInArrow(place, schema)
