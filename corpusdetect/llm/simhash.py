"""Near duplicates by SimHash fingerprints, searched by decoding parts of them with a Golay code.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Among fingerprints that differ in at
most 3 bits, these differ in (a, b, c) bits with a + b + c <= 3, so one of these holds:

* the third is equal and one of the others differs in at most 1 bit;
* one of the first two is equal and the other differs in at most 2 bits;
* all three differ in 1 bit, so one half of the third is equal.

Equal parts go into a key as they are, the others as numbers of nearby codewords. Words that differ in at most 2
bits share a codeword among the (one or six) within 4 bits of each; for 1 bit the nearest codeword of
either is among those of the other. That makes about 40 keys of 30 to 35 bits for a fingerprint, and
every link shares one. Buckets of a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import materialize
from .components import clusters
from .golay import near_codewords

WORDS = 3
SEED = 42
MAX_BITS = 3
# Members of one bucket that are compared with one another; larger ones are linked through their neighbourhoods.
BUCKET = 1024
# Shingles whose bits are added up at once.
_CHUNK = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is in over half of the XXH64 hashes of all word shingles, repeats included.

    No words: 0; fewer words than a shingle has: the whole sequence is the only shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - WORDS + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[-n:].tolist()
    totals = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
        totals += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint of every whole text, as a signed number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            values = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values)], names=["doc_id", "print"])

    return rows.mapInArrow(of, f"doc_id {kind}, print bigint")


def search_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every search key of the fingerprints, distinct for each.

    The upper bits of a key tell its kind. Kinds 0 and 1: the third segment and a codeword near the
    first or second; 2 and 3: the first or second segment and a codeword near the other; 4 and 5: half of
    the third segment and codewords near the others, all for one of the two and the nearest for the
    other, so that each side of a link has the key made of the nearest codewords of one segment each.
    """
    prints = prints.view(np.uint64)
    mask = np.uint64((1 << 23) - 1)
    first = (prints & mask).astype(np.int64)
    second = (prints >> np.uint64(23) & mask).astype(np.int64)
    third = (prints >> np.uint64(46)).astype(np.int64)
    one, two = near_codewords(first), near_codewords(second)
    both = np.concatenate([one << 12 | two[:, :1], one[:, :1] << 12 | two], axis=1)
    parts = [
        third[:, None] << 12 | one,
        third[:, None] << 12 | two,
        first[:, None] << 12 | two,
        second[:, None] << 12 | one,
        (third & 511)[:, None] << 24 | both,
        (third >> 9)[:, None] << 24 | both,
    ]
    keys = np.concatenate([p | kind << 40 for kind, p in enumerate(parts)], axis=1)
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


def _keyed(prints: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            if len(values):
                place, keys = search_keys(values)
                yield pa.record_batch([pa.array(keys), pa.array(values[place])], names=["key", "print"])

    return prints.select("print").mapInArrow(of, "key bigint, print bigint")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all members which chains of at most MAX_BITS bits a step connect; one fewer than members at most."""
    bits = prints.view(np.uint64)  # of a signed number, numpy counts the bits of its absolute value
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= MAX_BITS
    free = np.ones(len(prints), dtype=bool)
    links = []
    for start in range(len(prints)):
        if not free[start]:
            continue
        free[start] = False
        reached = [start]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(close[at] & free)
            free[new] = False
            reached.extend(new.tolist())
            links.extend((int(prints[at]), int(prints[x])) for x in new)
    return links


def _within_buckets(buckets: DataFrame) -> DataFrame:
    """(a, b): links inside buckets (a column ``prints``, an array of at most BUCKET different ones)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            pairs = at[sizes == 2]
            a, b = flat[pairs], flat[pairs + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
            links = list(zip(a[near].tolist(), b[near].tolist()))
            for start, size in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                links.extend(_forest(flat[start : start + size]))
            yield pa.record_batch(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return buckets.select("prints").mapInArrow(of, "a bigint, b bigint")


def _ball(print_: Column, bits: int) -> Column:
    """All numbers that differ from the print in at most 1 or 2 bits."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: print_.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    if bits == 1:
        return F.concat(F.array(print_), one)
    masks = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(62)),
            lambda i: F.transform(
                F.sequence(i + 1, F.lit(63)),
                lambda j: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
                + F.call_function("shiftleft", F.lit(1).cast("bigint"), j),
            ),
        )
    )
    return F.concat(F.array(print_), one, F.transform(masks, lambda m: print_.bitwiseXOR(m)))


def _within_crowds(crowded: DataFrame) -> DataFrame:
    """(a, b): links inside buckets of any size (rows key, print), without pairs.

    Every member marks the 65 numbers within 1 bit of it; all members at one number are linked with the
    least of them, which settles distances up to 2. A member outside the largest class of a bucket
    marks the 2,081 numbers within 2 bits too, and is linked with a member that is within 1 bit of one
    of these, which settles distance 3. No number has more than 65 members within 1 bit.
    """
    members = materialize(crowded.select("print").distinct(), "crowd")
    marks = members.select(F.col("print"), F.explode(_ball(F.col("print"), 1)).alias("spot"))
    spots = marks.groupBy("spot").agg(F.min("print").alias("hub"), F.collect_set("print").alias("all"))
    near = spots.where(F.size("all") > 1).select(F.col("hub").alias("a"), F.explode("all").alias("b"))
    near = materialize(near.where("a <> b").distinct(), "near-links")
    classes = clusters(near).select(F.col("id").alias("print"), F.col("component").alias("class"))
    classed = crowded.join(classes, "print", "left").withColumn("class", F.coalesce("class", "print"))
    sizes = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    outside = classed.join(largest, "key").where("class <> largest").select("print").distinct()
    asked = outside.select(F.col("print").alias("b"), F.explode(_ball(F.col("print"), 2)).alias("spot"))
    hubs = spots.select("spot", F.col("hub").alias("a"))
    return near.union(asked.join(hubs, "spot").where("a <> b").select("a", "b").distinct())


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct, a column ``print``) that chains of links do."""
    keyed = materialize(_keyed(prints), "search-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keyed.join(shared, "key"), "shared-keys")
    buckets = met.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("print").alias("prints"))
    found = _within_buckets(buckets.select("prints"))
    crowded = met.where(F.col("n") > BUCKET).select("key", "print")
    if not crowded.isEmpty():
        found = found.union(_within_crowds(crowded))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at MAX_BITS or fewer differing bits; the component is the smallest id reachable, null
    if only rows without an id are. Null texts and texts without words have the fingerprint 0 and are
    linked like others. Repeated rows are kept; an empty table gives no rows. Only different
    fingerprints are searched, so copies, however many, cost nothing.
    """
    described = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    owners = materialize(described.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    joined = clusters(links(owners.select("print"))).select(F.col("id").alias("print"), "component")
    classed = owners.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
    ids = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classed.join(ids, "component").select("print", "component_id")
    return described.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
