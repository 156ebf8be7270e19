"""Language of a text by string kernels.

The blended-spectrum presence kernel of two texts counts the byte sequences of one to three bytes
that both hold, over the root of the product of their numbers. Texts of each language are landmarks
(Nyström): a text becomes its kernel values against them, whitened by the landmarks' own kernel.
One-versus-rest kernel ridge regression on a bounded sample gives a weight per landmark and language.
Scoring multiplies a batch's presence matrix by the landmarks' and by the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

# Learning takes about so many documents of each language, none longer than MAX_CHARS.
ROWS_PER_LANGUAGE = 400
LANDMARKS = 128
MAX_CHARS = 100_000
RIDGE = 1e-2
SEED = 2
UNKNOWN = "und"
# Numbers of the sequences: three bytes, then two, then one.
_TWO, _ONE = 1 << 24, (1 << 24) + (1 << 16)
_ALL = _ONE + (1 << 8)
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    sequences: np.ndarray  # numbers of the sequences that a landmark holds
    presence: np.ndarray  # sequences × landmarks, over the roots of the landmarks' sizes
    weights: np.ndarray  # landmarks × languages


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return np.zeros(_ALL, dtype=np.int32)


def sequences_of(text: str) -> np.ndarray:
    """Numbers of the distinct sequences of one to three bytes of the lower-cased text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32)
    two = (raw[:-1] << 8) | raw[1:]
    codes = np.concatenate([(two[:-1] << 8) | raw[2:], two + _TWO, raw + _ONE])
    # Each keeps the place where it was written last: one per sequence is its own.
    places, order = _places(), np.arange(len(codes), dtype=np.int32)
    places[codes] = order
    return codes[places[codes] == order]


def _has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _kernel(texts: list[str], slots: np.ndarray, presence: np.ndarray) -> np.ndarray:
    """Kernel values of texts against the landmarks."""
    rows = np.zeros((len(texts), len(presence)), dtype=np.float32)
    sizes = np.ones(len(texts))
    for i, text in enumerate(texts):
        held = sequences_of(text)
        sizes[i] = max(1, len(held))
        slot = slots[held]
        rows[i, slot[slot >= 0]] = 1
    return (rows @ presence) / np.sqrt(sizes)[:, None]


def _slots(sequences: np.ndarray) -> np.ndarray:
    slots = np.full(_ALL, -1, dtype=np.int32)
    slots[sequences] = np.arange(len(sequences))
    return slots


_WORKER_SLOTS: dict[bytes, np.ndarray] = {}


def _slots_once(sequences: np.ndarray) -> np.ndarray:
    key = sequences.tobytes()
    if key not in _WORKER_SLOTS:
        _WORKER_SLOTS.clear()
        _WORKER_SLOTS[key] = _slots(sequences)
    return _WORKER_SLOTS[key]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from (text, language)."""
    languages = tuple(sorted({lang for _, lang in rows}))
    if not languages:
        return Model((), np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    by_language = {lang: [t for t, own in rows if own == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [t for lang in languages for t in by_language[lang][:each]]
    held = [sequences_of(t) for t in chosen]
    sequences = np.unique(np.concatenate(held))
    slots = _slots(sequences)
    presence = np.zeros((len(sequences), len(chosen)), dtype=np.float32)
    for j, own in enumerate(held):
        presence[slots[own], j] = 1 / np.sqrt(max(1, len(own)))
    texts = [t for t, _ in rows]
    values = np.concatenate([_kernel(texts[i : i + 256], slots, presence) for i in range(0, len(texts), 256)])
    own = _kernel(chosen, slots, presence).astype(np.float64)
    spread, axes = np.linalg.eigh((own + own.T) / 2)
    useful = spread > 1e-6 * spread.max()
    white = axes[:, useful] / np.sqrt(spread[useful])
    features = values.astype(np.float64) @ white
    target = np.array([[1.0 if lang == own_lang else -1.0 for lang in languages] for _, own_lang in rows])
    # Every language weighs the same, however many rows it has.
    share = np.array([1 / len(by_language[lang]) for _, lang in rows])[:, None]
    gram = features.T @ (features * share) + ridge * np.eye(features.shape[1]) / max(1, features.shape[1])
    return Model(languages, sequences, presence, white @ np.linalg.solve(gram, features.T @ (target * share)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample of the rows with a language that are not held out."""
    known = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    ).where(F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    sizes = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    if not sizes:
        return fit([])
    rates = [(lang, min(1.0, ROWS_PER_LANGUAGE / n)) for lang, n in sizes.items()]
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates for x in pair]), F.col("_lang"))
    place = F.shiftrightunsigned(F.xxhash64("_id", F.lit(SEED)), 12) / F.lit(float(1 << 52))
    rows = (
        known.where((place < rate) & (F.length("_text") <= MAX_CHARS) & F.col("_text").rlike(r"\p{L}"))
        .select("_id", "_text", "_lang")
        .collect()
    )
    rows.sort(key=lambda r: (hash_order(r["_id"]), r["_text"]))
    return fit([(r["_text"], r["_lang"]) for r in rows])


def hash_order(value) -> int:
    """An order that follows neither ids nor sources; ids that are no whole numbers go by their text."""
    if value is not None and not isinstance(value, int):
        value = zlib.crc32(str(value).encode())
    return (int(value or 0) * 0x9E3779B97F4A7C15) % (1 << 64)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; the first
    language by name of equals. The score is the winning language's regression value, moved from
    -1…1 to 0…1 and clipped. Null ids are never held out; repeated rows are kept; an empty table
    gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if model.languages and _has_letter(t)]
            for at in range(0, len(told), 128):
                some = told[at : at + 128]
                slots = _slots_once(model.sequences)
                values = _kernel([texts[i] for i in some], slots, model.presence) @ model.weights
                for i, row in zip(some, values, strict=True):
                    best = int(np.argmax(row))
                    named[i] = model.languages[best]
                    scores[i] = min(1.0, max(0.0, (float(row[best]) + 1) / 2))
            yield pa.record_batch(
                [batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    found = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
