"""Word shingles of texts as sets of 64-bit numbers, for a batch at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RANDOM = np.random.default_rng(20240517)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _RANDOM.integers(0, 1 << 64, WORDS, dtype=np.uint64)
_SHORT = _RANDOM.integers(0, 1 << 64, WORDS, dtype=np.uint64)
_BASE = np.uint64(int(_RANDOM.integers(0, 1 << 64, dtype=np.uint64)) | 1)
_POWERS = np.ones(64, dtype=np.uint64)
np.multiply.accumulate(np.full(63, _BASE, dtype=np.uint64), out=_POWERS[1:])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _BASE)])
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)  # bytes: A to Z only
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    counts = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    letters = np.flatnonzero(~blank)
    owner = np.cumsum(first[letters]) - 1
    place = letters - starts[owner]
    values = _BYTES[raw[letters]] * _powers(int(place.max()) + 1)[place]
    ends = np.searchsorted(letters, starts)
    return mixed(np.add.reduceat(values, ends)), counts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; texts with fewer words are one shingle, or none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, counts = word_hashes(raw)
    out, at = [], 0
    for n in counts.tolist():
        own, at = words[at : at + n], at + n
        if n >= WORDS:
            runs = own[: n - WORDS + 1] * _PLACE[0]
            for j in range(1, WORDS):
                runs = runs + own[j : n - WORDS + 1 + j] * _PLACE[j]
            out.append(np.unique(mixed(runs)))
        elif n:
            short = np.concatenate([own * _PLACE[:n], _SHORT[n : n + 1]])
            out.append(mixed(short.sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
