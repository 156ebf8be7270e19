"""A HAT-trie over sequences of word numbers: burstable hash containers below a shallow trie.

A sequence is a row of big-endian 32-bit numbers, padded with 0, and its key is its bytes. A node covers all
numbers of one word by ranges. A range holds a container, a hash table from what is left of the key to a
count. A container that outgrows its bound is cut in two between two first words; one that has a single
first word bursts into a node for the next word. So only the beginnings that many sequences share become nodes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np

# Entries of a container before it bursts.
CONTAINER = 16_384


def _matrix(container: Counter, width: int) -> np.ndarray:
    """The keys of a container as rows of numbers."""
    return np.frombuffer(b"".join(container), dtype=">u4").reshape(-1, width)


def _counts(container: Counter) -> np.ndarray:
    return np.fromiter(container.values(), dtype=np.int64, count=len(container))


class HatTrie:
    """Counts sequences of ``width`` words, or what follows the words above a node."""

    def __init__(self, width: int, bound: int = CONTAINER):
        self.width, self.bound = width, bound
        self.starts = [0]  # the first word number of each range
        self.slots: list[Counter | HatTrie] = [Counter()]

    def add(self, rows: np.ndarray) -> None:
        """Count rows of ``width`` big-endian 32-bit numbers."""
        rows = rows[np.argsort(rows[:, 0].astype(np.uint32), kind="stable")]
        cuts = [*np.searchsorted(rows[:, 0], np.array(self.starts, dtype=">u4")).tolist(), len(rows)]
        # From the last range on, as a burst moves the ranges behind it.
        for i in range(len(self.slots) - 1, -1, -1):
            own = rows[cuts[i] : cuts[i + 1]]
            if not len(own):
                continue
            slot = self.slots[i]
            if isinstance(slot, HatTrie):
                slot.add(np.ascontiguousarray(own[:, 1:]))
            else:
                slot.update(np.ascontiguousarray(own).view(f"V{4 * self.width}").ravel().tolist())
                self._burst(i)

    def _burst(self, i: int) -> None:
        """Cut the container in range ``i``, and its parts, until all are within the bound."""
        container = self.slots[i]
        if len(container) <= self.bound:
            return
        rows, counts = _matrix(container, self.width), list(container.values())
        keys = list(container)
        words = np.unique(rows[:, 0])
        if len(words) == 1:
            word = int(words[0])
            node = HatTrie(self.width - 1, self.bound)
            node.slots[0].update({k[4:]: n for k, n in zip(keys, counts)})
            # Other words of the range get containers of their own on both sides.
            parts: list[tuple[int, Counter | HatTrie]] = [(word, node), (word + 1, Counter())]
            if self.starts[i] < word:
                parts.insert(0, (self.starts[i], Counter()))
            if i + 1 < len(self.starts) and self.starts[i + 1] == word + 1:
                parts.pop()
            self.starts[i : i + 1], self.slots[i : i + 1] = [p[0] for p in parts], [p[1] for p in parts]
            node._burst(0)
            return
        # The middle entry's word begins the upper range, unless it is the least one.
        middle = max(np.sort(rows[:, 0])[len(rows) // 2], words[1])
        low, high = Counter(), Counter()
        for key, n, upper in zip(keys, counts, (rows[:, 0] >= middle).tolist()):
            (high if upper else low)[key] = n
        self.starts.insert(i + 1, int(middle))
        self.slots[i : i + 1] = [low, high]
        self._burst(i + 1)
        self._burst(i)

    def __len__(self) -> int:
        return sum(map(len, self.slots))

    def depth(self) -> int:
        return 1 + max((s.depth() for s in self.slots if isinstance(s, HatTrie)), default=0)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences and their counts, ordered by ranges, unordered within a container."""
        rows, counts = [np.zeros((0, self.width), dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for start, slot in zip(self.starts, self.slots):
            if isinstance(slot, HatTrie):
                rest, n = slot.entries()
                rows.append(np.column_stack([np.full(len(n), start, dtype=np.uint32), rest]))
                counts.append(n)
            elif slot:
                rows.append(_matrix(slot, self.width).astype(np.uint32))
                counts.append(_counts(slot))
        return np.concatenate(rows), np.concatenate(counts)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until at most ``keep`` entries stay."""
        out = HatTrie(self.width, self.bound)
        sizes = sorted(((len(s), i) for i, s in enumerate(self.slots)), reverse=True)
        left, taken = len(self), []
        for size, i in sizes:
            if left <= keep or not size:
                break
            left -= size
            taken.append(i)
        taken.sort()
        out.starts, out.slots = [self.starts[i] for i in taken], [self.slots[i] for i in taken]
        for i in taken:
            # A range that a burst made keeps its node, emptied.
            self.slots[i] = HatTrie(self.width - 1, self.bound) if isinstance(self.slots[i], HatTrie) else Counter()
        return out.entries()

    def count(self, row: tuple[int, ...]) -> int:
        i = bisect_left(self.starts, row[0] + 1) - 1
        slot = self.slots[i]
        if isinstance(slot, HatTrie):
            return slot.count(row[1:])
        return slot[np.array(row, dtype=">u4").tobytes()]
