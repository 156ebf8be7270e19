"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the words of toxic documents in
which byte sequences occur that mark them (frequent there, all but absent in ordinary text). A text is
read in overlapping windows; each is compressed with the ordinary dictionary alone and with the toxic
one behind it. Words of the windows that the toxic dictionary shortens are then compressed by
themselves with either dictionary. A document's evidence is the number of bytes that the toxic
dictionary saves on the few words on which it saves most; the threshold between the classes is calibrated on documents that neither
dictionary has seen.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below_rate, held_out

# Learning takes about so many documents of each class, none longer than MAX_CHARS; scoring takes all.
TOXIC_ROWS = 1200
ORDINARY_ROWS = 2400
MAX_CHARS = 100_000
ORDINARY_BYTES = 1 << 16
TOXIC_BYTES = 1 << 13
SEED = 5
# Marking sequences: bytes of those anywhere in a word and of the longest word beginning (both with the
# space in front), least share of toxic documents, least ratio of the shares.
GRAM = 5
BEGINNING = 10
LEAST_SHARE = 0.02
LEAST_ODDS = 20
STRIDE, WINDOW = 40, 64
# Words that make up the evidence of a text.
TOP = 3
SLOPE = 2.0
WRONGLY = 5
# Both dictionaries end with this, and every word is followed by it: a block is then never too short
# to be compressed, and the word is not among the last bytes, in which no match may begin.
_TAIL = bytes(range(1, 25))
# Between a dictionary's text and that, lest a match run from one into the other.
_GAP = b"\x1e" * 8
_WORD = re.compile(rb"[^ \n]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float
    # Without marks the toxic dictionary is trained on whole windows, and these are the evidence.
    marks: bool = True


def _prepared(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode() + b" "


def _grams(word: bytes) -> list[bytes]:
    """Sequences of a word (with the spaces around it) that may mark: its beginnings come last."""
    inside = [word[i : i + GRAM] for i in range(1, len(word) - GRAM + 1)]
    return inside + [word[:n] for n in range(GRAM, min(len(word), BEGINNING) + 1)]


def _words(text: bytes) -> set[bytes]:
    return {b" " + w + b" " for w in _WORD.findall(text)}


def _without_copies(texts: list[bytes]) -> list[bytes]:
    """The first of texts that share the least of their three-word hashes under one of four keys."""
    seen: set[tuple[int, int]] = set()
    kept = []
    keys = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)
    for text in texts:
        words = _WORD.findall(text)
        runs = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        hashes = np.fromiter(map(zlib.crc32, runs), dtype=np.uint32, count=len(runs))
        least = set(enumerate((hashes[:, None] * keys).min(axis=0).tolist()))
        if not least & seen:
            kept.append(text)
        seen |= least
    return kept


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard

    options = zstandard.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=options)
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options)


def _lengths(content: bytes, text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Compressed lengths of the parts of a text."""
    import zstandard

    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    parts = zstandard.BufferWithSegments(text, np.column_stack([starts, sizes]).astype(np.uint64).tobytes())
    packed = _compressor(content).multi_compress_to_buffer(parts)
    return np.fromiter(map(len, packed), dtype=np.int64, count=len(starts))


def savings(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(text, bytes) for the distinct words of short windows: what the toxic dictionary saves on each.

    Without marks, for the windows themselves.
    """
    # The last window of a text ends in the tail, so that a match may begin in the text's last bytes too.
    prepared = [_prepared(t) + _TAIL for t in texts]
    joined = b"".join(prepared)
    begins = np.cumsum([0, *map(len, prepared)])
    windows = [np.arange(0, len(t) - len(_TAIL), STRIDE) + b for t, b in zip(prepared, begins, strict=False)]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
    starts = np.concatenate(windows) if windows else np.zeros(0, np.int64)
    sizes = np.minimum(WINDOW, begins[owner + 1] - starts)
    plain = _lengths(model.ordinary, joined, starts, sizes)
    if not model.marks:
        return owner, plain - _lengths(model.toxic, joined, starts, sizes)
    saved = plain - _lengths(model.ordinary + model.toxic, joined, starts, sizes)
    words: list[set[bytes]] = [set() for _ in texts]
    for i in np.flatnonzero(saved > 0).tolist():
        own = int(owner[i])
        low = max(int(begins[own]), int(starts[i]) - 16)
        high = min(int(begins[own + 1]) - len(_TAIL), int(starts[i]) + WINDOW + 16)
        words[own].update(_WORD.findall(joined, low, high))
    owners = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    parts = [b" " + w + b" " + _TAIL for ws in words for w in sorted(ws)]
    ends = np.cumsum([0, *map(len, parts)])
    line = b"".join(parts)
    gain = _lengths(model.ordinary + _GAP + _TAIL, line, ends[:-1], np.diff(ends)) - _lengths(
        model.toxic + _GAP + _TAIL, line, ends[:-1], np.diff(ends)
    )
    return owners, gain


def evidence(texts: list[str | None], model: Model) -> np.ndarray:
    """Bytes that the toxic dictionary saves on the TOP words of each text on which it saves most."""
    owners, gain = savings(texts, model)
    order = np.lexsort([-gain, owners])
    owners, gain = owners[order], np.maximum(gain[order], 0)
    place = np.arange(len(owners)) - np.searchsorted(owners, owners)
    return np.bincount(owners[place < TOP], weights=gain[place < TOP], minlength=len(texts))


def score(found: np.ndarray, threshold: float) -> np.ndarray:
    return 1 / (1 + np.exp(-SLOPE * (found - threshold)))


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Learn from (text, toxic); without both classes nothing is ever toxic."""
    kinds: tuple[list[bytes], list[bytes]] = ([], [])
    for text, toxic in rows:
        kinds[toxic].append(_prepared(text))
    # What marks one text and its copies would else look like a mark of the class.
    kinds = tuple(map(_without_copies, kinds))
    learn = [[t for i, t in enumerate(k) if i % 4] for k in kinds]
    check = [[t for i, t in enumerate(k) if i % 4 == 0] for k in kinds]
    if not learn[0] or not learn[1]:
        return Model(b"", b"", math.inf)
    with_gram = [Counter(g for t in k for g in {g for w in _words(t) for g in _grams(w)}) for k in learn]
    marks = {
        g
        for g, n in with_gram[1].items()
        if n >= max(3, LEAST_SHARE * len(learn[1]))
        and n / len(learn[1]) >= LEAST_ODDS * (with_gram[0][g] + 0.5) / len(learn[0])
    }
    marked: Counter[bytes] = Counter()
    for text in learn[1]:
        for word in _words(text):
            found = [(word.find(g), word.find(g) + len(g)) for g in _grams(word) if g in marks]
            if found:
                marked[word[min(a for a, _ in found) : max(b for _, b in found)]] += 1
    # The most frequent come last: zstandard writes near matches shorter.
    order = sorted(marked, key=lambda w: (marked[w], w))
    toxic = b"".join(order)[-TOXIC_BYTES:]
    ordinary = _trained(learn[0], ORDINARY_BYTES)
    model = Model(ordinary, toxic or _trained(learn[1], ORDINARY_BYTES), 0.0, bool(toxic))
    # Texts are bytes again here; they are lower-cased and padded already.
    found = [evidence([t[1:-1].decode() for t in k], model) for k in (check if check[0] and check[1] else learn)]

    def right(threshold: float) -> tuple[float, float]:
        # Ordinary documents are far more: a share of them rejected weighs WRONGLY times as much.
        return (found[1] > threshold).mean() - WRONGLY * (found[0] > threshold).mean(), -abs(threshold - 3.5)

    highest = 29 if model.marks else int(max(map(max, found)))
    threshold = max((x + 0.5 for x in range(-1, highest + 1)), key=right)
    return replace(model, threshold=threshold)


def _trained(texts: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the windows of texts."""
    import zstandard

    windows = [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)]
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(texts)[-size:]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic): the bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")
    )
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    wanted = {0: ORDINARY_ROWS, 1: TOXIC_ROWS}
    keep = [
        (F.col("_toxic") == toxic) & below_rate(F.col("_id"), wanted[toxic] / n, SEED) for toxic, n in sizes.items()
    ]
    chosen = known.where(keep[0] | keep[-1]) if keep else known
    # As many ids as the sample has rows: the texts need not be moved to meet them.
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .where(F.length("_text") <= MAX_CHARS)
        .join(F.broadcast(chosen), "_id")
        .select("_id", "_text", "_toxic")
    )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, label_col).collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return fit([(r["_text"], r["_toxic"]) for r in rows])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` columns id and text read, one row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no evidence and a score near 0; null ids are never held out; repeated
    rows are kept; an empty table gives no rows. Whole texts are read, whatever their length.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = score(evidence(texts, model), model.threshold) if model.toxic else np.zeros(len(texts))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text is not predicted to be toxic."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.toxic:
                scores = score(evidence(batch.column(at).to_pylist(), model), model.threshold)
                batch = batch.filter(pa.array(scores < 0.5))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
