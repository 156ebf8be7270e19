"""Near-duplicate documents: banded MinHash, Bayesian pruning, exact verification.

1. Every text becomes its set of five-word shingles, a key of that set, a MinHash signature and the
   keys of its bands. Equal sets are one class, named by its smallest id.
2. Classes that share a band are a bucket. Each is paired with two pivots of the bucket first, and a
   pair's signatures are compared batch by batch: it is dropped as soon as the posterior probability
   that the similarity reaches the threshold is below the chosen miss probability. What survives ties
   classes into loose groups. Buckets whose members are then in different groups are dealt in blocks
   of bounded size, and signatures of different groups are compared in every pair of blocks: any two
   members of a bucket are of one group, or have been compared.
3. A group is compared in blocks of bounded size inside
   tasks: signatures batch by batch again, survivors on the full sets, skipping what is connected
   already. A group of one block is settled by that. In a larger one each block also holds a few hubs,
   which all blocks share; then only the classes outside the group's largest component are compared
   with all blocks.
4. Confirmed links make the components.

A pair at the threshold shares no band once in 190,000 cases. All that leaves a task are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import materialize
from .components import by_least, clusters, merged
from .shingles import mixed, shingle_sets

PERCENT = 75
BANDS, ROWS = 32, 4
MISS = 1e-6
BATCH = 32
BLOCK = 1000
HUBS = 64
# Members of a bucket that are dealt together.
DEALT = 1000
# A table of ids and their blocks of at most so many rows (some 50 bytes each) is sent to every executor.
BROADCAST_ROWS = 250_000
# Likewise for a list of bare ids.
BROADCAST_IDS = 1_000_000
_SIZE = BANDS * ROWS
_random = np.random.default_rng(64023)
_FACTOR = (_random.integers(0, 1 << 32, _SIZE, dtype=np.uint64) | 1).astype(np.uint32)
_SHIFT = _random.integers(0, 1 << 32, _SIZE, dtype=np.uint64).astype(np.uint32)
_BAND = _random.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values of the set under _SIZE permutations of 32-bit numbers."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_SIZE, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and signature; bands never share keys but by accident."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mixed((rows * _BAND[:, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def short_signatures(signatures: np.ndarray) -> np.ndarray:
    """One byte per permutation: enough to compare, as unequal values agree once in 256 cases."""
    return ((signatures >> np.uint32(8)) ^ signatures).astype(np.uint8)


@lru_cache(maxsize=4)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """Of 32, 64, … compared values, how many must agree for a pair to stay.

    With a uniform prior, the posterior after m of n agreements is Beta(m + 1, n − m + 1); its upper
    tail is a binomial sum. Accidental agreement of bytes only raises the count.
    """
    t = percent / 100

    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    return tuple(
        next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(BATCH, _SIZE + 1, BATCH)
    )


def surviving(left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two equally long signature tables survive all batches, and their agreements."""
    live = np.arange(len(left))
    agree = np.zeros(len(left), dtype=np.int32)
    for i, bound in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        agree = agree + (left[live, part] == right[live, part]).sum(axis=1, dtype=np.int32)
        stay = agree >= bound
        live, agree = live[stay], agree[stay]
    return live, agree


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_a, set_b, bands, short."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, short binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            empty = sizes == 0
            signatures = np.array([signature(s) for s in sets]).reshape(-1, _SIZE)
            keys = [
                np.array([f(s) for s in sets], dtype=np.uint64).view(np.int64)
                for f in (
                    lambda s: s.sum(dtype=np.uint64),
                    lambda s: mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64),
                )
            ]
            bands = band_keys(signatures)
            short = short_signatures(signatures)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes),
                    *(pa.array(k, mask=empty) for k in keys),
                    pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.reshape(-1)),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _bucketed(classes: DataFrame) -> DataFrame:
    """(id, band, p, q, n): the members of every bucket of more classes than one, with its pivots."""
    members = classes.select("id", F.explode("bands").alias("band"))
    pivots = (
        members.groupBy("band")
        .agg(
            F.min("id").alias("p"),
            F.max_by("id", F.xxhash64("id", "band")).alias("q"),
            F.max("id").alias("_top"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("p <> _top")
        .select("band", "p", "q", "n")
    )
    return members.join(pivots, "band").select("id", "band", "p", "q", "n")


def _pivot_pairs(bucketed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a class and a pivot of one of its buckets."""
    paired = bucketed.select("id", F.explode(F.array("p", "q")).alias("pivot")).where("id <> pivot")
    return paired.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def links_across(
    labels: list, sides: np.ndarray, sizes: np.ndarray, short: np.ndarray, percent: int, least: tuple[int, ...]
) -> list[tuple]:
    """Pairs of labels that join all labels between which the sizes and signatures of any pair let the threshold be reached.

    Where there are two sides, pairs of one side are left to other blocks.
    """
    order = np.argsort(sizes, kind="stable")
    _, label = np.unique(np.array(labels), return_inverse=True)
    label, side, size, short = label[order], sides[order], sizes[order], short[order]
    one_side = bool((side == side[0]).all())
    # By size, what is too large for a member lies behind all that is not.
    ends = np.searchsorted(size, 100 * size // percent, side="right")
    found = []
    for i in range(len(order)):
        part = slice(i + 1, int(ends[i]))
        apart = label[part] != label[i]
        others = i + 1 + np.flatnonzero(apart if one_side else apart & (side[part] != side[i]))
        if not len(others):
            continue
        live, _ = surviving(np.broadcast_to(short[i], (len(others), _SIZE)), short[others], least)
        for j in others[live].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((labels[order[i]], labels[order[j]]))
    return found


def _bucket_links(bucketed: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between the groups of members of a bucket; ``labels`` (id, component) has the groups."""
    kind, least = classes.schema["id"].dataType.simpleString(), least_matches(percent, miss)
    # In smaller buckets every member has met every other as a pivot.
    several = bucketed.where("n > 3 OR n = 3 AND p = q").select("id", "band", "n")
    several = several.join(labels, "id", "left").select("id", "band", "n", F.coalesce("component", "id").alias("label"))
    several = materialize(several, "bucket-members")
    code = F.xxhash64("id")
    opened = (
        several.groupBy("band")
        .agg(
            F.max("n").alias("n"),
            F.min("label").alias("_low"),
            F.max("label").alias("_high"),
            F.sum(F.shiftright(code, 32)).alias("_one"),
            F.sum(code.bitwiseAND(0xFFFFFFFF)).alias("_two"),
        )
        .where("_low <> _high")
    )
    # Bands that come from one passage have the same members: once is enough.
    opened = materialize(opened.groupBy("n", "_one", "_two").agg(F.min("band").alias("band")).select("band"), "open-buckets")
    number = F.ceil(F.col("n") / DEALT).cast("int")
    own = _place(number, F.col("id"), 4).cast("int")
    block = F.explode(F.sequence(F.lit(0), number - 1)).alias("_with")
    signed = classes.select("id", "n_shingles", "short")
    dealt = several.join(opened, "band").select("id", "band", "label", own.alias("_own"), block).join(signed, "id")
    dealt = dealt.select(
        "band",
        F.least("_own", "_with").alias("low"),
        F.greatest("_own", "_with").alias("high"),
        F.when(F.col("_own") <= F.col("_with"), 0).otherwise(1).alias("side"),
        "label",
        "n_shingles",
        "short",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], None

        def settle() -> list[tuple]:
            if len(held) < 2 or (key[1] != key[2] and len({x[0] for x in held}) < 2):
                return []
            sides, labels, sizes, short = zip(*held, strict=True)
            table = np.frombuffer(b"".join(short), dtype=np.uint8).reshape(-1, _SIZE)
            return links_across(list(labels), np.array(sides), np.array(sizes), table, percent, least)

        def batch_of(links: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in links], kind) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            links, kind = [], batch.schema.field(4).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if row[:3] != key:
                    links += settle()
                    key, held = row[:3], []
                held.append(row[3:])
            if links:
                yield batch_of(links, kind)
        links = settle()
        if links:
            yield batch_of(links, kind)

    dealt = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return materialize(dealt.mapInArrow(compare, f"a {kind}, b {kind}"), "bucket-links")


def _prune(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs whose sizes and signatures let the threshold be reached."""
    least = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, _SIZE) for i in (2, 3)
            ]
            live, _ = surviving(*tables, least)
            yield pa.record_batch([batch.column(i).take(pa.array(live)) for i in (0, 1)], names=["a", "b"])

    kind = classes.schema["id"].dataType.simpleString()
    one = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("_na"), F.col("short").alias("_sa"))
    two = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("_nb"), F.col("short").alias("_sb"))
    fits = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
    return (
        pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "_sa", "_sb").mapInArrow(run, f"a {kind}, b {kind}")
    )


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def links_of_block(
    ids: list, sets: list[np.ndarray], labels: list, sides: list[int], percent: int, least: tuple[int, ...]
) -> list[tuple]:
    """Links that connect the members of a block as far as any pair of it reaches the threshold.

    Sides: 0 for the block, 1 for hubs and for those that are compared with it. Members of one label
    are connected already, and links name them by it. Hubs among themselves are left to their own blocks.
    """
    n = len(ids)
    names = [i if label is None else label for i, label in zip(ids, labels, strict=True)]
    short = short_signatures(np.array([signature(s) for s in sets]))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_label: dict = {}
    for i, label in enumerate(labels):
        if label is not None:
            parent[root(i)] = root(by_label.setdefault(label, i))
    side = np.array(sides)
    found = []
    for i in range(n):
        others = np.arange(i + 1, n)
        others = others[side[others] + side[i] < 2]
        live, agree = surviving(np.broadcast_to(short[i], (len(others), _SIZE)), short[others], least)
        for j in others[live][np.argsort(-agree, kind="stable")].tolist():
            if root(i) != root(j) and _linked(sets[i], sets[j], percent):
                parent[root(i)] = root(j)
                found.append((names[i], names[j]))
    return found


def _compare(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int, miss: float) -> DataFrame:
    """Links within each block of ``members``: (id, label, blocks: array of (grp, block, side))."""
    spark, kind = docs.sparkSession, members.schema["id"].dataType.simpleString()
    members = materialize(members, "members")
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(members, "id")
    rows = f"id {kind}, label {kind}, blocks array<struct<grp:{kind},block:int,side:int>>, shingles binary"
    least = least_matches(percent, miss)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("_text").to_pylist())
            yield pa.record_batch(
                [batch.column(x) for x in ("id", "label", "blocks")] + [pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "label", "blocks", "shingles"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> list[tuple]:
            if len(held) < 2:
                return []
            ids, labels, sides, raw = zip(*held, strict=True)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
            return links_of_block(list(ids), sets, list(labels), list(sides), percent, least)

        def batch_of(links: list[tuple]) -> pa.RecordBatch:
            kind = pa.int64() if not links or isinstance(links[0][0], int) else pa.string()
            return pa.record_batch([pa.array([x[i] for x in links], kind) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            links = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[:2] != key:
                    links += settle()
                    key, held = row[:2], []
                held.append((row[3], row[4], row[2], row[5]))
            if links:
                yield batch_of(links)
        links = settle()
        if links:
            yield batch_of(links)

    dealt = texts.select("id", "label", "blocks", "_text").mapInArrow(with_sets, rows)
    dealt = dealt.withColumn("_at", F.explode("blocks"))
    dealt = dealt.select("_at.grp", "_at.block", "_at.side", "id", "label", "shingles")
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block")
    return materialize(dealt.mapInArrow(compare, f"a {kind}, b {kind}"), "links")


def _place(number, key, seed: int):
    return F.pmod(F.xxhash64(key, F.lit(seed)), number)


def _blocks(groups: DataFrame) -> DataFrame:
    """Every member in its block; in groups of more blocks, hubs in all of them."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    placed = groups.join(sizes, "component").withColumn("_own", _place(F.col("_blocks"), F.col("id"), 1).cast("int"))
    hub = (F.col("_blocks") > 1) & (_place(F.col("_n"), F.col("id"), 2) < HUBS)
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    at = F.when(hub, every).otherwise(F.array("_own"))
    blocks = F.transform(
        at,
        lambda i: F.struct(
            F.col("component").alias("grp"), i.cast("int").alias("block"), (i != F.col("_own")).cast("int").alias("side")
        ),
    )
    return placed.select(
        "id", "component", "_blocks", F.lit(None).cast(groups.schema["id"].dataType).alias("label"), blocks.alias("blocks")
    )


def _rest_blocks(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """For groups of more blocks: those outside the largest component against every block."""
    labels = labels.select("id", F.col("component").alias("_found"))
    known = placed.where("_blocks > 1").select("id", "component", "_blocks").join(labels, "id", "left")
    known = known.select("id", "component", "_blocks", F.coalesce("_found", "id").alias("label"))
    sizes = known.groupBy("component", "label").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("_n", "label")).alias("_top"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    largest = largest.where("_most < _all").withColumn(
        "_parts", F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int")
    )
    known = known.join(largest, "component")
    own = _place(F.col("_blocks"), F.col("id"), 1).cast("int")
    part = _place(F.col("_parts"), F.col("id"), 3).cast("int")
    number = F.col("_blocks")

    def at(block, piece, side: int):
        # One number for a pair of a block and a part of the rest.
        return F.struct(
            F.col("component").alias("grp"),
            (piece * number + block).cast("int").alias("block"),
            F.lit(side).alias("side"),
        )

    as_block = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: at(own, p, 0))
    as_rest = F.transform(F.sequence(F.lit(0), number - 1), lambda b: at(b, part, 1))
    rest = F.col("label") != F.col("_top")
    # A row of the rest is also in its own block there; the other copy of itself is the same id.
    return known.select("id", "label", F.when(rest, F.concat(as_block, as_rest)).otherwise(as_block).alias("blocks"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space after lower-casing A to Z; a text of fewer than five words
    is one shingle. Null and empty texts have no shingles and are linked with nothing; rows without
    an id are neither linked and are kept, with a null component; rows with one id count as one
    document, linked with whatever any of them is. An empty table gives no rows.
    """
    described = materialize(describe(docs, id_col, text_col), "described")
    full = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    named = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"))
    named = materialize(named, "classes")
    ids = named.select("id").distinct()
    classes = materialize(
        full.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").select("id", "n_shingles", "bands", "short"),
        "class-signatures",
    )
    bucketed = materialize(_bucketed(classes), "bucketed")
    pairs = materialize(_prune(_pivot_pairs(bucketed), classes, percent, miss), "pairs")
    groups = clusters(pairs)
    across = _bucket_links(bucketed, classes, groups, percent, miss)
    if not across.isEmpty():
        groups = merged(groups, clusters(across))
    placed = materialize(_blocks(groups), "blocks")
    # An id with several sets belongs to several classes: their names are linked through it.
    found = clusters(_compare(docs, placed.select("id", "label", "blocks"), id_col, text_col, percent, miss))
    if not placed.where("_blocks > 1").isEmpty():
        rest = _rest_blocks(placed, found)
        found = merged(found, clusters(_compare(docs, rest, id_col, text_col, percent, miss)))
    found = by_least(found)
    by_set = described.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    joined = by_set.join(found, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, unchanged, of the kept documents; repeated ids once, rows without an id all."""
    described = materialize(near_duplicates(docs, id_col, text_col, **options), "near-duplicates")
    gone = materialize(described.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:  # else the texts are shuffled to meet them
        gone = F.broadcast(gone)
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    ids = described.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    again = materialize(ids.select(F.col("doc_id").alias(id_col)), "repeated-ids")
    n_again = again.count()
    if not n_again:
        return kept
    if n_again <= BROADCAST_IDS:
        again = F.broadcast(again)
    # Rows without an id match none and stay where they are.
    once = kept.join(again, id_col, "left_anti").select(*docs.columns)
    rows = kept.join(again, id_col, "left_semi").select(
        F.col(id_col).alias("id"), F.struct(F.col(text_col).isNull(), F.col(text_col)).alias("order"), F.struct(*docs.columns).alias("row")
    )
    # Reduced in each task first, so an id with very many rows is no hot key.
    least = rows.groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return once.union(least.select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w)
), n AS (
  SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
