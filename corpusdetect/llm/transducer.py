"""A piece tokenizer as a deterministic transducer that emits token counts.

Byte-pair encoding of a prefix is settled locally: the last token at a position is the one piece
ending there that may follow the last token at the piece's start. What the future can still depend on
is therefore finite: for every start inside the longest piece, the trie node reached from it, what
may follow the last token there, and the count there relative to the current one. Such a tuple is a
state. Where few pieces are left below a node, those that may follow are listed instead of the last
token, which makes most states fall together or drop out. A transition reads a
character and carries the change of the token count. States and transitions are compiled when a text
first needs them and then live in dense arrays, so texts are scanned in many lanes at once.

A position between a character and a following space symbol is always a token border, as is any
position beside a character that no piece holds: there the state falls back to the first one.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
# Below a trie node with at most this many pieces, those that may follow are listed.
FEW = 16
# Arrays are compiled anew beyond this many entries, and what only speeds up compiling is forgotten
# beyond this many facts: workers keep a bounded memory.
MAX_ENTRIES = 30_000_000
MAX_FACTS = 500_000
# Characters that a lane reads.
LANE = 384
_MOST = 0x110000


class Pieces:
    """Pieces and merge ranks, read from a piece model's own listing."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.rank):
            raise ValueError("pieces must hold the space symbol in front only")
        self.nodes: list[dict[str, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        for piece in self.rank:
            node = 0
            for c in piece:
                if c not in self.nodes[node]:
                    self.nodes[node][c] = len(self.nodes)
                    self.nodes.append({})
                    self.piece_at.append(None)
                node = self.nodes[node][c]
            self.piece_at[node] = piece
        self.characters = {c for p in self.rank for c in p}
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.below: list[tuple[int, ...] | None] = [()] * len(self.nodes)
        for node in range(len(self.nodes) - 1, -1, -1):  # children have larger numbers
            own = [x for child in self.nodes[node].values() for x in (child, *(self.below[child] or ()))]
            own = [x for x in own if self.piece_at[x] is not None]
            wide = any(self.below[child] is None for child in self.nodes[node].values())
            self.below[node] = None if wide or len(own) > FEW else tuple(sorted(own))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._own: dict[str, tuple] = {}
        self._guards: dict[tuple, tuple] = {}

    def forget(self, most: int = 0) -> None:
        for x in (self._pairs, self._own, self._guards):
            if len(x) > most:
                x.clear()

    def _merges(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """Ranks of a piece's own merges in order, then infinity; first and last part before each."""
        known = self._own.get(piece)
        if known is None:
            parts, ranks, first, last = list(piece), [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                pairs = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
                at = min(range(len(pairs)), key=pairs.__getitem__)
                if pairs[at] == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                ranks.append(pairs[at])
                first.append(parts[0])
                last.append(parts[-1])
            ranks.append(np.inf)
            known = self._own[piece] = (ranks, first, last)
        return known

    def follows(self, a: str, b: str) -> bool:
        """Whether the border between two neighbouring pieces survives all merges.

        The best-ranked merge comes first, the leftmost of equals: those inside each piece are known,
        so only the pair at the border has to be looked up.
        """
        known = self._pairs.get((a, b))
        if known is None:
            known = a[-1] + b[0] not in self.neighbours
            if not known:
                left, _, ends = self._merges(a)
                right, begins, _ = self._merges(b)
                i = j = 0
                while True:
                    across = self.rank.get(ends[i] + begins[j], np.inf)
                    if left[i] <= across and left[i] <= right[j]:
                        if left[i] == np.inf:
                            known = True
                            break
                        i += 1
                    elif across <= right[j]:
                        break
                    else:
                        j += 1
            self._pairs[a, b] = known
        return known

    def guard(self, node: int, last: str | tuple):
        """What of the pieces below ``node`` may come: those listed, or those after ``last``."""
        below = self.below[node]
        if below is None or not last:
            return last if below is None else below
        known = self._guards.get((node, last))
        if known is None:
            if isinstance(last, tuple):
                known = tuple(x for x in below if x in last)
            else:
                known = tuple(x for x in below if self.follows(last, self.piece_at[x]))
            self._guards[node, last] = known
        return known


class CountTransducer:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self) -> None:
        # A state: ((trie node, last token or pieces that may come, count before now), …) by open start.
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.columns = np.full(_MOST, -1, dtype=np.int32)
        self.letters: list[str] = []
        self.next = np.full((1024, 64), -1, dtype=np.int32)
        self.gain = np.zeros((1024, 64), dtype=np.int8)
        self.first = self._state(((0, "", 0),))
        self.pieces.forget()

    def _state(self, key: tuple) -> int:
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = len(self.keys)
            self.keys.append(key)
            if known == len(self.next):
                self._grow(len(self.next) * 2, self.next.shape[1])
        return known

    def _grow(self, rows: int, columns: int) -> None:
        for name, fill in (("next", -1), ("gain", 0)):
            old = getattr(self, name)
            new = np.full((rows, columns), fill, dtype=old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)

    def _compile(self, state: int, column: int) -> None:
        """The transition of a state under a character that pieces hold."""
        letter, nodes, piece_at = self.letters[column], self.pieces.nodes, self.pieces.piece_at
        opened, found = [], None
        for node, last, before in self.keys[state]:
            reached = nodes[node].get(letter)
            if reached is None:
                continue
            piece = piece_at[reached]
            if piece is not None and (
                reached in last if isinstance(last, tuple) else not last or self.pieces.follows(last, piece)
            ):
                if found is not None:
                    raise ValueError(f"{found[0]!r} and {piece!r} both end here: merges are not local")
                found = (piece, before + 1)
            if nodes[reached]:
                guard = self.pieces.guard(reached, last)
                if guard != ():
                    opened.append((reached, guard, before))
        if found is None:
            raise ValueError(f"no piece ends with {letter!r} here")
        piece, gain = found
        # Entries come in the order of their starts, the longest first.
        key = (*((node, guard, before - gain) for node, guard, before in opened), (0, piece, 0))
        self.next[state, column], self.gain[state, column] = self._state(key), gain

    def _columns_of(self, codes: np.ndarray) -> np.ndarray:
        columns = self.columns[codes]
        if (columns == -1).any():
            for code in np.unique(codes[columns == -1]).tolist():
                letter = chr(code)
                if letter not in self.pieces.characters:
                    # No piece holds it: as many tokens as bytes.
                    self.columns[code] = -1 - len(letter.encode("utf-8", "surrogatepass"))
                    continue
                if len(self.letters) == self.next.shape[1]:
                    self._grow(len(self.next), self.next.shape[1] + 16)
                self.columns[code] = len(self.letters)
                self.letters.append(letter)
            columns = self.columns[codes]
        return columns

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text; each gets a space symbol in front, an empty one has none."""
        if self.next.size > MAX_ENTRIES:
            self._forget()
        self.pieces.forget(MAX_FACTS)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        total = int(lengths.sum())
        if not total:
            return np.zeros(len(texts), dtype=np.int64)
        joined = "".join(SPACE + t for t in texts if t)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
        codes[codes == 0x20] = ord(SPACE)
        columns = self._columns_of(codes)
        ends = np.cumsum(lengths)
        space = codes == ord(SPACE)
        fresh = np.zeros(total, dtype=bool)  # positions that the first state reads
        fresh[1:] = space[1:] & ~space[:-1]
        fresh[1:] |= columns[:-1] < 0
        fresh[ends[lengths > 0] - lengths[lengths > 0]] = True
        gains = self._scan(columns, fresh)
        sums = np.concatenate([[0], np.cumsum(gains, dtype=np.int64)])
        return sums[ends] - sums[ends - lengths]

    def _scan(self, columns: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Gains per position, by composing the state maps of chunks.

        A chunk's map is constant from its first fresh position on, so all chunks run that part at
        once. The maps of chunks without one are learned at the states they are likely to be entered
        with, again at once: states forget soon, so a chunk read from the first state tells how the next
        one is entered. Composing these maps along the text shows which entries are still missing;
        they are learned together, and so on. Chunks of equal content share a map, so that text which
        repeats itself, and never forgets, takes few rounds too.
        """
        total = len(columns)
        chunks = -(-total // LANE)
        padded = np.full(chunks * LANE, -2, dtype=np.int32)
        padded[:total] = columns
        marks = np.zeros(chunks * LANE, dtype=bool)
        marks[:total] = fresh
        gains = np.zeros(chunks * LANE, dtype=np.int8)
        marks = marks.reshape(chunks, LANE)
        constant = marks.any(axis=1)
        head = np.where(constant, marks.argmax(axis=1), LANE)
        starts = np.arange(chunks) * LANE
        leaving = np.full(chunks, -1, dtype=np.int64)
        tails = np.flatnonzero(constant)
        leaving[tails] = self._run(
            padded, marks.reshape(-1), gains, starts[tails] + head[tails], LANE - head[tails], np.full(len(tails), self.first)
        )
        open_ = np.flatnonzero(~constant)
        if len(open_):
            self._compose(padded, gains, open_, leaving)
        heads = tails[head[tails] > 0]  # the first chunk begins with a fresh position
        self._run(padded, marks.reshape(-1), gains, starts[heads], head[heads], leaving[heads - 1])
        return gains[:total]

    def _compose(self, padded: np.ndarray, gains: np.ndarray, open_: np.ndarray, leaving: np.ndarray) -> None:
        """Fill in gains and ``leaving`` of the chunks ``open_``, which have no fresh position."""
        _, example, content = np.unique(padded.reshape(-1, LANE)[open_], axis=0, return_index=True, return_inverse=True)
        content = content.ravel().tolist()
        maps: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        none = np.zeros(len(padded), dtype=bool)

        def learn(entries: list[tuple[int, int]]) -> None:
            # One run for each entry of a chunk: a chunk cannot be read from several states at once.
            while entries:
                now = list({c: (c, state) for c, state in entries}.values())
                at = open_[example[[c for c, _ in now]]] * LANE
                left = self._run(padded, none, gains, at, np.full(len(now), LANE), np.array([s for _, s in now]))
                for entry, start, state in zip(now, at.tolist(), left.tolist()):
                    maps[entry] = (state, gains[start : start + LANE].copy())
                entries = [e for e in entries if e not in maps]

        learn([(c, self.first) for c in set(content)])
        while True:
            missing: dict[tuple[int, int], None] = {}
            entered = []
            for chunk, c in zip(open_.tolist(), content):
                entry = (c, int(leaving[chunk - 1]))
                if entry not in maps:
                    missing[entry] = None
                    # Go on with what is likely.
                    leaving[chunk] = maps[c, self.first][0]
                else:
                    leaving[chunk] = maps[entry][0]
                entered.append(entry)
            if not missing:
                break
            learn(list(missing))
        for chunk, entry in zip(open_.tolist(), entered):
            gains[chunk * LANE : (chunk + 1) * LANE] = maps[entry][1]

    def _run(self, columns, fresh, gains, starts, lengths, states) -> np.ndarray:
        """Read ``lengths`` characters from each start; returns the states at the ends."""
        order = np.argsort(-lengths, kind="stable")
        at, state = starts[order].copy(), states[order].astype(np.int64)
        sizes = lengths[order]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            here = at[:live] + step
            column = columns[here]
            now = np.where(fresh[here], self.first, state[:live])
            outside = column < 0
            column_in = np.where(outside, 0, column)
            then = self.next[now, column_in]
            missing = (then < 0) & ~outside
            if missing.any():
                for s, c in {*zip(now[missing].tolist(), column[missing].tolist(), strict=True)}:
                    self._compile(s, c)
                then = self.next[now, column_in]
            gains[here] = np.where(outside, -1 - column, self.gain[now, column_in])
            state[:live] = np.where(outside, self.first, then)
        back = np.empty_like(state)
        back[order] = state
        return back
