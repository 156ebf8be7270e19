"""K-way merging with a tree of losers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

_ENDED = object()


def merge(runs: Sequence[Iterable[tuple]]) -> Iterator[tuple]:
    """All rows of sorted runs in order; of equal rows the one of the earlier run first.

    Runs are read as they are needed, one row ahead. Inner nodes keep the run that lost there, the root's
    winner is next. After a run's head is taken, its next head is played against the losers on the way
    up only: one comparison per level.
    """
    k = len(runs)
    if not k:
        return
    rest = [iter(run) for run in runs]
    heads = [next(run, _ENDED) for run in rest]

    def before(x: int, y: int) -> bool:
        """Whether run x comes before run y; runs at their end, and missing ones, come last."""
        if x < 0 or heads[x] is _ENDED:
            return False
        if y < 0 or heads[y] is _ENDED:
            return True
        a, b = heads[x], heads[y]
        return a < b or (a == b and x < y)

    leaves = 1
    while leaves < k:
        leaves *= 2
    losers = [-1] * leaves
    winners = [-1] * (2 * leaves)
    winners[leaves : leaves + k] = range(k)
    for node in range(leaves - 1, 0, -1):
        left, right = winners[2 * node], winners[2 * node + 1]
        ahead = before(left, right) or not before(right, left)
        winners[node], losers[node] = (left, right) if ahead else (right, left)
    champion = winners[1] if leaves > 1 else 0
    while champion >= 0 and heads[champion] is not _ENDED:
        yield heads[champion]
        heads[champion] = next(rest[champion], _ENDED)
        node = (leaves + champion) // 2
        while node:
            if before(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2
