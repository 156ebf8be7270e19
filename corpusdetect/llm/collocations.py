"""Phrases of words that occur together more often than apart, counted in HAT-tries.

Words are counted first. Then every task counts the windows of words at each place of its texts in one
HAT-trie a language; when that is full, its largest subtrees are written as runs, sorted by the words' 64-bit
numbers and cut by prefix. The prefix of a window is its first two words, a longer one where these are
very frequent; all runs of a partition of prefixes meet in one task, which merges them and so has the whole
counts of all phrases with these prefixes. Runs name the most frequent words by a list of bounded length, and
all others themselves, so no vocabulary is sent around.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import materialize
from .hattrie import CONTAINER, HatTrie

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
COVERED_PERCENT = 80
NO_LANG = "und"
# Very frequent words: more occurrences than a 32nd of a partition, and no more words than this.
HOT_WORDS = 65_536
_SEED = 42
# Bits of the table of frequent words: 2 MB, whatever the vocabulary.
_FILTER_BITS = 24
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
# No word has a capital letter after lower-casing, so one can stand for the end of a piece.
_END = b"A"


@dataclass(frozen=True)
class Limits:
    """What a task holds; results do not depend on it."""

    entries: int = 1_000_000  # of the tries of a task, before it writes runs
    container: int = CONTAINER  # entries of a hash container before it bursts
    vocabulary: int = 500_000  # words
    partition: int = 4_000_000  # windows of one partition of prefixes, on average
    one_level: int = 64  # partitions that runs are cut for at once; with more, in two steps
    chunk: int = 4 << 20  # bytes of text that are taken apart at once
    id_bits: int = 64  # of a word's first hash
    shared: int = 1 << 18  # words that runs name by their place in a list that goes to all tasks


def _plain(b: int) -> int:
    if 0x41 <= b <= 0x5A:
        return b + 32
    return 0x0A if b in _SEPARATORS else 0x20 if b == 0x09 else b


_TABLE = bytes(map(_plain, range(256)))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")
    ).where("text IS NOT NULL")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Per language the texts of a batch, lower-cased, pieces ended by new lines and words by blanks."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        texts[lang].append(text)
    for lang, some in texts.items():
        yield lang, b"\n".join(some).translate(_TABLE)


def _digest(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED)


# ------------------------------------------------------------------ words


def _word_counts(texts: DataFrame, limits: Limits) -> DataFrame:
    """(lang, word, f)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, own in counts.items():
                words = pa.array(list(own), pa.binary()).cast(pa.string())
                yield pa.record_batch(
                    [pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())],
                    names=["lang", "word", "f"],
                )
            counts.clear()

        for batch in batches:
            for lang, raw in _by_lang(batch):
                at = 0
                while at < len(raw):
                    end = _after(raw, at, limits.chunk)
                    counts[lang].update(raw[at:end].split())
                    at = end
            if sum(map(len, counts.values())) > limits.vocabulary:
                yield from flush()
        yield from flush()

    partial = texts.mapInArrow(of, "lang string, word string, f bigint")
    return partial.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _after(raw: bytes, at: int, size: int) -> int:
    """The end of a chunk: the first blank or new line after ``size`` bytes."""
    ends = [e for e in (raw.find(b" ", at + size), raw.find(b"\n", at + size)) if e >= 0]
    return min(ends) if ends else len(raw)


def _numbered(words: DataFrame, limits: Limits) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """Adds ``id``, a number that no other word of the language has; and the ids that are not a first hash.

    Words whose first hashes clash, of ten billion about three, are numbered by a second hash.
    """
    words = materialize(words, "words")
    mask = (1 << limits.id_bits) - 1
    first = F.xxhash64("word").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
    shared = words.groupBy("lang", first.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # Zero stands for no word.
    shared = shared.where("n > 1 OR id = 0").select("lang", F.col("id").alias("_id"))
    clash = words.withColumn("_id", first).join(shared, ["lang", "_id"], "left_semi").select("lang", "word").collect()
    second = {(r.lang, r.word): _digest(b"A" + r.word.encode()) for r in clash}
    if not second:
        return words.withColumn("id", first), {}
    spark = words.sparkSession
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    named = spark.createDataFrame([(*k, signed(v)) for k, v in second.items()], "lang string, word string, other bigint")
    words = words.join(named, ["lang", "word"], "left").withColumn("id", F.coalesce("other", first)).drop("other")
    if words.groupBy("lang", "id").count().where("count > 1").limit(1).count():
        raise ValueError("two hashes do not tell all words apart")
    return words, second


# ---------------------------------------------------------------- windows


class _Numbers(dict):
    """Words by bytes: numbers by first occurrence, 0 for the end of a piece and for words that are surely rare."""

    def __init__(self, lang: str, other: dict[tuple[str, str], int], frequent: np.ndarray, id_bits: int):
        super().__init__({_END: 0})
        self.lang, self.other, self.frequent, self.mask = lang, other, frequent, (1 << id_bits) - 1
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        own = _digest(word) & self.mask
        if self.other:
            own = self.other.get((self.lang, word.decode()), own)
        bit = own % (1 << _FILTER_BITS)
        number = 0
        if self.frequent[bit >> 3] >> (bit & 7) & 1:
            number = len(self.hashes)
            self.hashes.append(own)
        self[word] = number
        return number


class _Reader:
    """Windows of one language in a task: word numbers by first occurrence, and the trie over them."""

    def __init__(self, lang: str, other: dict[tuple[str, str], int], frequent: np.ndarray, limits: Limits):
        self.lang, self.other, self.frequent, self.limits = lang, other, frequent, limits
        self.reset()

    def reset(self) -> None:
        self.numbers = _Numbers(self.lang, self.other, self.frequent, self.limits.id_bits)
        self.open = np.zeros(0, dtype=np.uint32)
        self.trie = HatTrie(LONGEST, self.limits.container)

    def read(self, raw: bytes) -> None:
        raw = raw.replace(b"\n", b" " + _END + b" ") + b" " + _END
        at = 0
        while at < len(raw):
            end = _after(raw, at, self.limits.chunk)
            tokens = raw[at:end].split()
            self.feed(np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
            at = end

    def feed(self, numbers: np.ndarray) -> None:
        """Count the windows that begin at all places but the last ones, which wait for what follows."""
        numbers = np.concatenate([self.open, numbers])
        n = len(numbers) - LONGEST + 1
        if n <= 0:
            self.open = numbers
            return
        self.open = numbers[n:]
        rows = np.empty((n, LONGEST), dtype=">u4")
        rows[:, 0] = numbers[:n]
        for k in range(1, LONGEST):
            rows[:, k] = np.where(rows[:, k - 1] == 0, 0, numbers[k : k + n])
        # One word alone is counted already.
        self.trie.add(rows[(rows[:, 0] != 0) & (rows[:, 1] != 0)])

    def end(self) -> None:
        self.feed(np.zeros(LONGEST - 1, dtype=np.uint32))
        self.open = self.open[:0]

    def hashes(self) -> np.ndarray:
        """The words' own numbers by their number here; 0 for none."""
        return np.array(self.numbers.hashes, dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = (a ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(29))


def _based(own: np.ndarray, rows: np.ndarray, counts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (places in ``own``) and counts, and the shortest phrase that each counts for.

    Where two or three first words are all hot, windows go by a longer prefix, and their sums stand in for
    the phrases above.
    """
    is_hot = np.isin(own, hot)
    base = np.full(len(rows), 2)
    upper = []
    for k in range(2, LONGEST):
        all_hot = is_hot[rows[:, :k]].all(axis=1) & (base == k)
        sums = rows[all_hot].copy()
        sums[:, k:] = 0
        if len(sums):
            sums, owner = np.unique(sums, axis=0, return_inverse=True)
            total = np.bincount(owner.ravel(), weights=counts[all_hot]).astype(np.int64)
            upper.append((sums, total, np.full(len(sums), k)))
            base[all_hot] = k + 1
            # What ends here counts for nothing longer.
            over = all_hot & (rows[:, k] == 0)
            rows, counts, base = rows[~over], counts[~over], base[~over]
    return tuple(np.concatenate([x, *[u[i] for u in upper]]) for i, x in enumerate((rows, counts, base)))


def _parts(lang: str, own: np.ndarray, rows: np.ndarray, base: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each window's prefix."""
    key = _mix(own[rows[:, 0]], own[rows[:, 1]]) + np.uint64(_digest(lang.encode()))
    for k in range(2, LONGEST):
        key = np.where(base > k, _mix(key, own[rows[:, k]]), key)
    return (key % np.uint64(parts)).astype(np.int64)


class _Codes:
    """How runs write words: the most frequent ones by their place in a list that all tasks have, others in own lists.

    Code 0 is no word. The list is of bounded length, by falling frequency, so codes are mostly small.
    """

    def __init__(self, shared: np.ndarray):
        self.shared = shared
        self._order = np.argsort(shared)
        self._sorted = shared[self._order]

    def of(self, own: np.ndarray) -> np.ndarray:
        """Codes of words by number; -1 for those that are not in the list."""
        at = np.minimum(np.searchsorted(self._sorted, own), len(self._sorted) - 1)
        return np.where(self._sorted[at] == own, self._order[at], -1)


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, bytes of one weight together."""
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _runs(
    codes: _Codes, own: np.ndarray, rows: np.ndarray, counts: np.ndarray, base: np.ndarray, deal: np.ndarray
) -> Iterator[tuple]:
    """Sorted runs (deal, base, words, grams, counts): words that are not in the common list, windows as codes."""
    wide = rows.astype(np.uint64)
    group = deal * 8 + base
    order = np.lexsort((wide[:, 2] << np.uint64(32) | wide[:, 3], wide[:, 0] << np.uint64(32) | wide[:, 1], group))
    rows, counts, group = rows[order], counts[order], group[order]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    common = codes.of(own)
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
        grams = common[rows[a:b].T.ravel()]
        apart = np.flatnonzero(grams < 0)
        words, index = np.unique(rows[a:b].T.ravel()[apart], return_inverse=True)
        grams[apart] = len(codes.shared) + index
        yield int(group[a]) // 8, int(group[a]) % 8, own[words].tobytes(), _packed(grams, 4), _packed(counts[a:b], 8)


class _Merge:
    """Sorted runs of one language, merged by ranges of their first two words."""

    def __init__(self, codes: _Codes, runs: list[tuple[int, bytes, bytes, bytes]]):
        tables = [np.frombuffer(words, dtype=np.uint64) for _, words, _, _ in runs]
        self.own = np.unique(np.concatenate([codes.shared, *tables]))
        self.common = np.searchsorted(self.own, codes.shared).astype(np.uint64)
        self.runs = []
        for (base, _, packed, counts), table in zip(runs, tables):
            others = np.searchsorted(self.own, table).astype(np.uint64)
            grams = _unpacked(packed, 4).reshape(LONGEST, -1)
            upper = self._pairs(grams[:2], others)
            # Codes of the last two words are looked up range by range.
            self.runs.append((base, others, grams[2:].copy(), upper, _unpacked(counts, 8).astype(np.int64)))

    def _pairs(self, grams: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Two words a number, by their places in ``own``; codes beyond the common list are a run's own."""
        known = len(self.common)
        places = self.common[np.minimum(grams, known - 1)]
        apart = grams >= known
        places[apart] = others[grams[apart] - known]
        return places[0] << np.uint64(32) | places[1]

    def __len__(self) -> int:
        return sum(len(r[3]) for r in self.runs)

    def ranges(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(upper, lower, counts, base) in order, about ``size`` windows at once: two places a number, none split."""
        n = len(self) // size + 1
        sample = np.sort(np.concatenate([r[3][:: max(1, size // 1024)] for r in self.runs]))
        cuts = np.unique(sample[[len(sample) * i // n for i in range(1, n)]])
        at = [[0, *np.searchsorted(r[3], cuts).tolist(), len(r[3])] for r in self.runs]
        for i in range(len(cuts) + 1):
            parts = []
            for (base, others, grams, upper, counts), ends in zip(self.runs, at):
                own = slice(ends[i], ends[i + 1])
                parts.append((upper[own], self._pairs(grams[:, own], others), counts[own], np.full(ends[i + 1] - ends[i], base)))
            upper, lower, counts, base = map(np.concatenate, zip(*parts))
            if len(upper):
                order = np.lexsort((base, lower, upper))
                yield upper[order], lower[order], counts[order], base[order]

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, counts, base): equal windows as one, places in ``own``."""
        for upper, lower, counts, base in self.ranges(size):
            begins = np.flatnonzero(_fresh(upper, lower, base))
            columns = [x[begins] >> np.uint64(shift) & _PLACE for x in (upper, lower) for shift in (32, 0)]
            yield np.column_stack(columns).astype(np.uint32), np.add.reduceat(counts, begins), base[begins]

    def phrases(self, size: int, min_count: int) -> Iterator[tuple[list[list[int]], list[int]]]:
        """Phrases by their words' numbers with at least ``min_count`` occurrences, and these."""
        for upper, lower, counts, base in self.ranges(size):
            third = lower >> np.uint64(32)
            for n, keys in ((2, (upper,)), (3, (upper, third)), (4, (upper, lower))):
                begins = np.flatnonzero(_fresh(*keys))
                totals = np.add.reduceat(np.where(base <= n, counts, 0), begins)
                keep = (totals >= min_count) & (keys[-1][begins] & _PLACE != 0)
                at = begins[keep]
                columns = [x[at] >> np.uint64(shift) & _PLACE for x in (upper, lower) for shift in (32, 0)]
                yield self.own[np.column_stack(columns[:n])].view(np.int64).tolist(), totals[keep].tolist()


_PLACE = np.uint64(0xFFFFFFFF)


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    out = np.ones(len(keys[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


_RUN = pa.schema([("deal", pa.int64()), ("lang", pa.string()), ("base", pa.int32()), ("words", pa.binary()),
                  ("grams", pa.binary()), ("counts", pa.binary())])
_RUN_DDL = "deal bigint, lang string, base int, words binary, grams binary, counts binary"
_GRAM = pa.schema([("lang", pa.string()), ("gram", pa.list_(pa.int64())), ("a", pa.int64())])


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bits of all ids of ``frequent``: a table of fixed size that says of a word that it is surely rare, or not."""
    bit = F.pmod(F.col("id"), F.lit(1 << _FILTER_BITS))
    packed = frequent.groupBy(F.shiftright(bit, 5).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(id, {1 << _FILTER_BITS}) & 31 as int))")).alias("bits")
    )
    table = np.zeros(1 << (_FILTER_BITS - 5), dtype="<u4")
    found = packed.toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy().astype("<u4")
    return table.view(np.uint8)


def _most_frequent(words: DataFrame, most: int) -> np.ndarray:
    """Ids of at most ``most`` words, by falling frequency after a 0: all above the least power of two that allows it."""
    steps = words.groupBy(F.floor(F.log2("f")).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 64, 0
    for step, n in sorted(((r.step, r.n) for r in steps), reverse=True):
        held += n
        if held > most:
            break
        least = step
    found = words.where(F.floor(F.log2("f")) >= least).groupBy("id").agg(F.max("f").alias("f")).toArrow()
    ids = found["id"].to_numpy()[np.argsort(-found["f"].to_numpy(), kind="stable")]
    return np.concatenate([np.zeros(1, dtype=np.uint64), ids.view(np.uint64)])


def _spilled(
    texts: DataFrame,
    other: dict[tuple[str, str], int],
    hot: dict[str, list[int]],
    frequent: np.ndarray,
    parts: int,
    within: int,
    codes: Broadcast,
    limits: Limits,
) -> DataFrame:
    """Runs of all tasks, dealt by partition of prefixes, or by ``within`` of them together."""
    frequent = texts.sparkSession.sparkContext.broadcast(frequent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, _Reader] = {}

        def write(reader: _Reader, keep: int) -> Iterator[pa.RecordBatch]:
            rows, counts = reader.trie.spill(keep)
            if len(rows):
                # From numbers of this task to places in the order of the words' own numbers, the least of which is 0.
                own, place = np.unique(reader.hashes(), return_inverse=True)
                rows, counts, base = _based(own, place.astype(np.uint32)[rows], counts, np.array(hot.get(reader.lang, []), dtype=np.uint64))
                part = _parts(reader.lang, own, rows, base, parts)
                yield from _batches(reader.lang, _runs(codes.value, own, rows, counts, base, part // within))

        for batch in batches:
            for lang, raw in _by_lang(batch):
                reader = readers.setdefault(lang, _Reader(lang, other, frequent.value, limits))
                reader.read(raw)
                if len(reader.numbers) > limits.vocabulary:
                    reader.end()
                    yield from write(reader, 0)
                    reader.reset()
            while sum(len(r.trie) for r in readers.values()) > limits.entries:
                largest = max(readers.values(), key=lambda r: len(r.trie))
                yield from write(largest, len(largest.trie) // 4)
            if sum(len(r.numbers) for r in readers.values()) > 2 * limits.vocabulary:
                for reader in readers.values():
                    reader.end()
                    yield from write(reader, 0)
                readers.clear()
        for reader in readers.values():
            reader.end()
            yield from write(reader, 0)

    return texts.mapInArrow(of, _RUN_DDL)


def _batches(lang: str, runs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for run in runs:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((run[0], lang, *run[1:]), _RUN)], schema=_RUN)


def _redealt(spilled: DataFrame, parts: int, coarse: int, codes: Broadcast, limits: Limits) -> DataFrame:
    """Runs of many tasks merged into longer ones, dealt by partition.

    With many partitions a task's runs would be cut into very short ones. So they are cut coarsely first;
    a task merges what it gets, as much as a partition holds at a time, and cuts it finely.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = defaultdict(list)
        size: Counter = Counter()

        def write(lang: str) -> Iterator[pa.RecordBatch]:
            merge = _Merge(codes.value, runs.pop(lang))
            size.pop(lang)
            rows, counts, base = (np.concatenate(x) for x in zip(*merge.windows(limits.entries)))
            yield from _batches(lang, _runs(codes.value, merge.own, rows, counts, base, _parts(lang, merge.own, rows, base, parts)))

        for batch in batches:
            for _, lang, *run in zip(*(c.to_pylist() for c in batch.columns)):
                runs[lang].append(tuple(run))
                # A window takes some ten bytes in a run.
                size[lang] += (len(run[1]) + len(run[2])) // 10 + 1
                if size.total() > limits.partition:
                    yield from write(max(size, key=size.get))
        for lang in list(runs):
            yield from write(lang)

    return spilled.repartition(coarse, "deal").mapInArrow(of, _RUN_DDL)


def _phrase_counts(
    texts: DataFrame,
    other: dict,
    hot: dict[str, list[int]],
    frequent: np.ndarray,
    parts: int,
    shared: np.ndarray,
    min_count: int,
    limits: Limits,
) -> DataFrame:
    """(lang, gram, a): phrases of 2 words and more with at least ``min_count`` occurrences."""
    codes = texts.sparkSession.sparkContext.broadcast(_Codes(shared))

    def merge(table: pa.Table) -> pa.Table:
        runs = defaultdict(list)
        for row in zip(*(table.column(c).to_pylist() for c in ("lang", "base", "words", "grams", "counts"))):
            runs[row[0]].append(row[1:])
        langs, grams, counts = [], [], []
        for lang, own in runs.items():
            for phrases, found in _Merge(codes.value, own).phrases(limits.entries, min_count):
                langs += [lang] * len(found)
                grams += phrases
                counts += found
        return pa.table([pa.array(x, f.type) for x, f in zip((langs, grams, counts), _GRAM)], schema=_GRAM)

    if parts <= limits.one_level:
        spilled = _spilled(texts, other, hot, frequent, parts, 1, codes, limits)
    else:
        within = isqrt(parts)
        coarse = _spilled(texts, other, hot, frequent, parts, within, codes, limits)
        spilled = _redealt(coarse, parts, parts // within + 1, codes, limits)
    return spilled.repartition(parts, "deal").groupBy("deal").applyInArrow(merge, "lang string, gram array<bigint>, a bigint")


# ----------------------------------------------------------------- scores


def _subphrases(size: Column) -> Column:
    """Every contiguous part of 2 words and more that is shorter than the column ``gram``."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("gram", i, n)),
        )
    )


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    covered_percent: int = COVERED_PERCENT,
    limits: Limits = Limits(),
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A is lower-cased to Z only. Marks and line ends part a text into pieces, blanks a piece into words; a
    phrase is 2 to LONGEST words in a row of one piece, with ``a`` occurrences. It is scored by its
    lowest-scoring cut into parts with ``l`` and ``r`` occurrences, the first on ties:
    floor(SCALE * a / (l + r)). A phrase within a longer one that has ``covered_percent`` of its
    occurrences is left out. ``n`` is the number of all words of the language. Null texts hold nothing, a
    null language is "und", repeated rows count as often as they occur, an empty table gives no rows.

    Words below ``min_count`` occur in no candidate, so windows end before them, as far as a table of
    2 ** 24 bits knows them; the others do no harm, as all phrases are counted to the end. A task holds the windows of ``limits`` and those of a batch; one prefix has at most a
    32nd of a partition's windows, or one in HOT_WORDS of all.
    """
    texts = _texts(docs, lang_col, text_col)
    words, other = _numbered(_word_counts(texts, limits), limits)
    words = materialize(words, "numbered-words")
    sums = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    parts = max(1, ceil(total / limits.partition))
    # No more than HOT_WORDS words can have so many occurrences.
    hot_from = max(limits.partition // 32, total // HOT_WORDS + 1)
    hot: dict[str, list[int]] = {}
    for row in words.where(F.col("f") >= hot_from).select("lang", "id").collect():
        hot.setdefault(row.lang, []).append(row.id % (1 << 64))
    words = words.where(F.col("f") >= min_count)
    shared = _most_frequent(words, limits.shared)
    found = materialize(_phrase_counts(texts, other, hot, _filter(words), parts, shared, min_count, limits), "phrases")

    known = words.select("lang", F.array("id").alias("gram"), F.col("f").alias("a")).union(found)
    size = F.size("gram")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("gram", F.lit(1), F.col("k"))).withColumn("rest", F.slice("gram", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(known.select("lang", F.col("gram").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("gram").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    exact = F.expr(f"(CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0))) div CAST(l + r AS DECIMAL(20, 0))")
    lowest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "gram", "a").agg(lowest).select("lang", "gram", "a", "cut.score", "cut.l", "cut.r")

    inside = found.where(size > 2).select("lang", F.explode(_subphrases(size)).alias("gram"), "a")
    longer = inside.groupBy("lang", "gram").agg(F.max("a").alias("longer"))
    scored = scored.join(longer, ["lang", "gram"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))
    ).drop("longer")

    # Names for numbers, a word at a time.
    spelled = scored.select("*", F.posexplode("gram").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "gram", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "l", "r", "score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = spelled.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(F.col("_rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(F.broadcast(sums) if sums.limit(100_001).count() <= 100_000 else sums, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k::BIGINT AS size, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM w))) GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang
), c AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM g WHERE size >= 2 AND a >= 30
), k AS (
  SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, f.a AS l, r.a AS r, (2000000::HUGEINT * k.a // (f.a + r.a))::BIGINT AS score
  FROM k JOIN g f ON f.lang = k.lang AND f.phrase = k.first JOIN g r ON r.lang = k.lang AND r.phrase = k.rest
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1
), u AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + n - 1], ' ') AS sub
    FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c))) GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank,
       s.phrase, s.a, s.l, s.r, n.n, s.score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN u ON u.lang = s.lang AND u.sub = s.phrase
WHERE u.longer IS NULL OR 100 * u.longer < 80 * s.a
QUALIFY rank <= 2000
"""
