"""The binary Golay code of length 23: every word of 23 bits lies within 3 bits of one codeword.

A word is decoded by its syndrome. ``near_codewords`` gives all codewords within 4 bits: the nearest
one, and five more where that is 3 bits away. Two facts follow from the code being perfect and are
tested for all error patterns: words that differ in at most 2 bits have a codeword within 4 bits in common, and
of words that differ in at most 1 bit, the codeword nearest to one is within 4 bits of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
# Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    """Of a polynomial over two elements, divided by the generator."""
    for place in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> place & 1:
            word ^= GENERATOR << (place - CHECKS)
    return word


def _syndromes() -> np.ndarray:
    """Syndromes of the 4,096 values of the upper 12 bits, by those bits."""
    table = np.zeros(1, dtype=np.int64)
    for place in range(CHECKS, LENGTH):
        table = np.concatenate([table, table ^ _remainder(1 << place)])
    return table


def _errors() -> np.ndarray:
    """Per syndrome the error patterns of at most 4 bits: the one of up to 3 first, then five or none (its repetition)."""
    single = [_remainder(1 << i) for i in range(LENGTH)]
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            syndrome = pattern = 0
            for i in places:
                syndrome ^= single[i]
                pattern |= 1 << i
            found[syndrome].append(pattern)
    return np.array([f if len(f) == 6 else f * 6 for f in found], dtype=np.int64)


_UPPER, _ERRORS = _syndromes(), _errors()


def near_codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) numbers below 4,096 of the codewords within 4 bits of each word, the nearest first.

    Where only one is that near, it stands six times.
    """
    words = words.astype(np.int64)
    syndromes = _UPPER[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    return (words[:, None] ^ _ERRORS[syndromes]) >> CHECKS
