"""Byte regexes compiled into one deterministic automaton.

The expressions know literals, ``\\xHH`` and escaped characters, classes, groups, ``(?i:…)``, ``|``,
``?``, ``*``, ``+`` and counts. They become one nondeterministic automaton (an accepting state per
rule), which subset construction and partition refinement turn into minimal transition arrays over
classes of bytes.
"""

from __future__ import annotations

import numpy as np

DEAD = -1


class _Parser:
    """A regex as nested tuples: ("set", bytes), ("cat", …), ("or", …), ("times", part, low, high)."""

    def __init__(self, regex: str):
        self.text, self.at, self.either_case = regex, 0, False

    def parse(self):
        tree = self._either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return tree

    def _look(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self):
        options = [self._sequence()]
        while self._look() == "|":
            self._next()
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def _sequence(self):
        parts = []
        while self._look() not in ("", "|", ")"):
            part = self._atom()
            while self._look() and self._look() in "?*+{":
                part = ("times", part, *self._count())
            parts.append(part)
        return ("cat", *parts)

    def _count(self) -> tuple[int, int | None]:
        sign = self._next()
        if sign != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at : end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _atom(self):
        sign = self._next()
        if sign == "(":
            before = self.either_case
            if self.text.startswith("?i:", self.at):
                self.at, self.either_case = self.at + 3, True
            inner = self._either()
            if self._next() != ")":
                raise ValueError(f"open group in {self.text!r}")
            self.either_case = before
            return inner
        if sign == "[":
            chosen: set[int] = set()
            while self._look() != "]":
                low = self._byte(self._next())
                if self._look() == "-" and self.text[self.at + 1] != "]":
                    self._next()
                    chosen.update(range(low, self._byte(self._next()) + 1))
                else:
                    chosen.add(low)
            self._next()
            return self._set(chosen)
        return self._set({self._byte(sign)})

    def _byte(self, sign: str) -> int:
        if sign != "\\":
            return ord(sign)
        sign = self._next()
        if sign != "x":
            return ord(sign)
        self.at += 2
        return int(self.text[self.at - 2 : self.at], 16)

    def _set(self, chosen: set[int]):
        if self.either_case:
            letters = {b for b in chosen if chr(b).isascii() and chr(b).isalpha()}
            chosen = chosen | {b ^ 0x20 for b in letters}
        return ("set", frozenset(chosen))


def _reversed(tree):
    """The tree of what a regex matches, read backwards."""
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "times":
        return (kind, _reversed(rest[0]), *rest[1:])
    return (kind, *map(_reversed, reversed(rest) if kind == "cat" else rest))


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Build ``tree`` from ``start``; returns where it ends."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((rest[0], end))
            return end
        if kind == "cat":
            for part in rest:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in rest:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        part, low, high = rest
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            first, end = self.state(), self.state()
            self.free[start] += [first, end]
            self.free[self.add(part, first)] += [first, end]
            return end
        end = self.state()
        for _ in range(high - low):
            self.free[start].append(end)
            first = self.state()
            self.free[start].append(first)
            start = self.add(part, first)
        self.free[start].append(end)
        return end


class Automaton:
    """``next[state, class]``, ``accepts[state]`` (a bit per rule), ``classes[byte]``; state 0 is first.

    ``anywhere`` compiles for matches that may begin at any byte; else a state without a way on is
    DEAD. Byte 255, which no UTF-8 text holds, always leads back to the first state.
    """

    def __init__(self, rules: list[str], anywhere: bool, backwards: bool = False):
        nfa = _Nfa()
        root = nfa.state()
        rule_of = {}
        for i, rule in enumerate(rules):
            first = nfa.state()
            nfa.free[root].append(first)
            tree = _Parser(rule).parse()
            rule_of[nfa.add(_reversed(tree) if backwards else tree, first)] = 1 << i
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        kinds: dict[tuple, int] = {}
        self.classes = np.array(
            [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], dtype=np.uint8
        )
        members = [[c for c in range(len(kinds)) if any(self.classes[b] == c for b in s)] for s in sets]
        of_set = dict(zip(sets, members, strict=True))

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for other in nfa.free[todo.pop()]:
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
            return frozenset(s for s in seen if nfa.moves[s] or s in rule_of)

        begin = closed([root])
        known, todo, rows = {begin: 0}, [begin], []
        for subset in todo:  # grows while it is read
            reach: list[set[int]] = [set() for _ in kinds]
            for state in subset:
                for chosen, end in nfa.moves[state]:
                    for c in of_set[chosen]:
                        reach[c].add(end)
            row = []
            for ends in reach:
                then = closed(ends) | begin if anywhere else closed(ends)
                if not then:
                    row.append(DEAD)
                    continue
                if then not in known:
                    known[then] = len(todo)
                    todo.append(then)
                row.append(known[then])
            rows.append(row)
        accepts = np.array([sum({rule_of[s] for s in subset if s in rule_of}) for subset in todo], dtype=np.int64)
        self._minimise(np.array(rows, dtype=np.int64), accepts)
        if self.next[:, self.classes[255]].max() > 0:
            raise ValueError("byte 255 must be in no class")

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Refine the partition by acceptance until equal states go to equal parts."""
        _, part = np.unique(accepts, return_inverse=True)
        while True:
            then = np.where(table < 0, -1, part[table])
            _, finer = np.unique(np.column_stack([part, then]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        one = np.unique(part, return_index=True)[1]
        order = np.argsort(one, kind="stable")  # the first state's part comes first
        name = np.empty(len(one), dtype=np.int64)
        name[order] = np.arange(len(one))
        rows = table[one[order]]
        self.next = np.where(rows < 0, DEAD, name[part[rows]]).astype(np.int16)
        self.accepts = accepts[one[order]].astype(np.uint8)

    def states(self, text: np.ndarray, lane: int = 512) -> np.ndarray:
        """The state after every byte, from the first state on; for ``anywhere`` only.

        All pieces of ``lane`` bytes are read at once as if they began in the first state. Where the
        piece before has ended in another one, the piece is read again from there, up to where both
        readings agree; that is soon, as states forget.
        """
        if not len(text):
            return np.empty(0, dtype=np.int16)
        width, flat = self.next.shape[1], self.next.reshape(-1)
        lanes = -(-len(text) // lane)
        kinds = np.full(lanes * lane, self.classes[255], dtype=np.uint8)
        kinds[: len(text)] = self.classes[text]
        columns = np.ascontiguousarray(kinds.reshape(lanes, lane).T)
        out = np.empty((lane, lanes), dtype=np.int16)
        state = np.zeros(lanes, dtype=np.int32)
        for step in range(lane):
            state = flat[state * width + columns[step]].astype(np.int32)
            out[step] = state
        enter = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
        dirty = np.flatnonzero(enter)
        while len(dirty):
            state, live = enter[dirty], dirty
            for step in range(lane):
                state = flat[state * width + columns[step, live]].astype(np.int32)
                apart = state != out[step, live]
                out[step, live] = state
                live, state = live[apart], state[apart]
                if not len(live):
                    break
            # Those that never agreed leave in another state than the next piece was told.
            after = live[live + 1 < lanes] + 1
            dirty = after[enter[after] != out[-1, after - 1]]
            enter[dirty] = out[-1, dirty - 1]
        return out.T.reshape(-1)[: len(text)]

    def longest(self, text: bytes, start: int) -> tuple[int, int]:
        """End and rules of the longest match at ``start``; an end of -1 if none."""
        state, end, rules, rows, classes = 0, -1, 0, self._rows, self._classes
        for at in range(start, len(text)):
            state = rows[state][classes[text[at]]]
            if state < 0:
                break
            if self._accepts[state]:
                end, rules = at + 1, self._accepts[state]
        return end, rules

    def prepare(self, backwards: str | None = None) -> Automaton:
        """Plain lists for ``longest``, and which bytes a match can begin with.

        With ``backwards``, the rule's regex, only places are tried at which a match does begin.
        """
        self.behind = None if backwards is None else Automaton([backwards], anywhere=True, backwards=True)
        self._rows, self._classes = self.next.tolist(), self.classes.tolist()
        self._accepts = self.accepts.tolist()
        self.begins = (self.next[0] >= 0)[self.classes]
        return self

    def leftmost(self, text: bytes) -> list[tuple[int, int]]:
        """Leftmost-longest matches that do not overlap."""
        found, free = [], 0
        raw = np.frombuffer(text, dtype=np.uint8)
        if self.behind is None:
            starts = np.flatnonzero(self.begins[raw])
        else:
            starts = np.flatnonzero(self.behind.accepts[self.behind.states(np.ascontiguousarray(raw[::-1]))][::-1])
        for start in starts.tolist():
            if start >= free:
                end, _ = self.longest(text, start)
                if end > start:
                    found.append((start, end))
                    free = end
        return found
