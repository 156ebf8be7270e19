"""Token ids of whole texts, with the ids of repeated words remembered."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

# Words remembered by a worker, and the longest of them.
MAX_WORDS = 400_000
MAX_LENGTH = 64
# New words that are encoded at once.
_LINE = 512
# White space as the libraries count it; a space next to any of it is part of a longer run.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]
# The word splitting of byte-level tokenizers (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str):
    """A faster encoder of the same vocabulary, where ids rise in the order of the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, splitter = content["model"], content["pre_tokenizer"] or {}
    merges = [x if isinstance(x, str) else " ".join(x) for x in model.get("merges", ())]
    ids = [model["vocab"].get(x.replace(" ", "", 1), -1) for x in merges]
    plain = (splitter.get("type"), splitter.get("use_regex", True), splitter.get("add_prefix_space")) == (
        "ByteLevel",
        True,
        False,
    )
    odd = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout")
    if model["type"] != "BPE" or not plain or odd or content["normalizer"] or ids != sorted(set(ids)):
        return None
    letters, special = _byte_letters(), {x["content"] for x in content["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    if not {bytes([b]) for b in range(256)} <= set(ranks):
        return None
    return tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def _touching(text: str) -> bool:
    """Whether a space touches other white space."""
    return "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _WHITE if c != " ")


def _flat(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    return np.fromiter(chain.from_iterable(runs), dtype="<u4", count=int(sizes.sum())), sizes


class _Pool:
    """Runs of ids one behind the other, known by number."""

    def __init__(self):
        self.flat, self.ends, self.n = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 14, dtype=np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[self.n])
        total = used + len(ids)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used:total] = ids
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def drop_to(self, n: int) -> None:
        self.n = n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs in this order in one array, and where each ends."""
        begins = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begins
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at + np.repeat(begins - (ends - sizes), sizes)], ends


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers in one string of bytes.

    Byte-level pair encodings with word splitting never join what comes before a single space to
    what comes after: a token may begin with that space, none reaches over it. Texts are therefore
    encoded word by word; a text in which a space touches other white space is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._ranked = _ranked(path)
        if self._ranked is not None:
            # Whether a token begins with a space.
            self._begins = np.zeros(self._ranked.max_token_value + 1, dtype=bool)
            for token in self._ranked.token_byte_values():
                self._begins[self._ranked.encode_single_token(token)] = token.startswith(b" ")
        added = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added)) or r"\b\B")
        self._known: dict[str, int] = {}
        self._pool = _Pool()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self._ranked is None:
            return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        encode, special = self._ranked.encode_ordinary, self._special.search
        return [self._tokenizer.encode(t, add_special_tokens=False).ids if special(t) else encode(t) for t in texts]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a space in front, and how many each has.

        Words are encoded in lines: none holds a space, so a token that begins with one begins a word. A word
        that ends in other white space, which would join the next space, or holds a special string goes alone.
        """
        if self._ranked is None:
            return _flat(self._encode([" " + w for w in words]))
        alone = np.fromiter((w[-1:].isspace() for w in words), dtype=bool, count=len(words))
        ids, sizes = [], []
        for at in range(0, len(words), _LINE):
            some = words[at : at + _LINE]
            line = "".join([" " + w for w in some])
            if alone[at : at + _LINE].any() or self._special.search(line):
                found, each = _flat(self._encode([" " + w for w in some]))
            else:
                found = np.array(self._ranked.encode_ordinary(line), dtype="<u4")
                each = np.diff(np.append(np.flatnonzero(self._begins[found]), len(found)))
            ids.append(found)
            sizes.append(each)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else _flat([])

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self._known) > MAX_WORDS:
            self._known, self._pool = {}, _Pool()
        known, pool = self._known, self._pool
        # The first word has no space in front, so it is not one of the remembered ones.
        heads, words, sizes = [], [], []
        for text in texts:
            first, *rest = [text] if _touching(text) else text.split(" ")
            heads.append(first)
            words += rest
            sizes.append(len(rest))
        new = list(set(words).difference(known))
        short, long = [w for w in new if len(w) <= MAX_LENGTH], [w for w in new if len(w) > MAX_LENGTH]
        known.update(zip(short, range(pool.n, pool.n + len(short))))
        pool.add(*self._encode_words(short))
        # What is not remembered stands behind the rest for this call.
        remembered = pool.n
        known.update(zip(long, range(pool.n, pool.n + len(long))))
        pool.add(*_flat(self._encode([" " + w for w in long])))
        first_head = pool.n
        pool.add(*_flat(self._encode(heads)))
        numbers = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        at = np.cumsum([0, *sizes])
        numbers = np.insert(numbers, at[:-1], np.arange(first_head, first_head + len(heads)))
        flat, ends = pool.gather(numbers)
        borders = [0, *ends[at[1:] + np.arange(len(texts))].tolist()]
        for word in long:
            del known[word]
        pool.drop_to(remembered)
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(borders, borders[1:])]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
