"""Collocations against brute force, and the tries below them."""

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from corpusdetect.llm import collocations, hattrie

DOCS = "doc_id bigint, text string, lang string, source string, word string, f int, id string, gram int, a int, n int"


def plain(rows, min_count, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def answer(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["a", "B", "cc", "dd", "é", "É", "😀", "x-y", "A's", "\x1cq", "zz"]
    weights = [30, 20, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    texts = []
    for i in range(150):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 90))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ; ", "\x0b"]) for w in words)
        texts.append((text, rng.choice(["en", "de", None, "und", ""])))
    texts += [(None, "en"), ("", "fr"), (" .,\n", "fr"), (None, None), texts[0], texts[0], ("a b " * 70_000, "en")]
    texts += [("strong tea is strong tea", "en")] * 40
    return texts


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [(i, t, lang, "s", "w", i, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(more, DOCS).repartition(4)


def test_awkward_rows_equal_brute_force(spark, rows, docs):
    assert answer(collocations.collocations(docs, min_count=5)) == plain(rows, 5)
    assert answer(collocations.collocations(docs, min_count=3, top=4)) == plain(rows, 3, 4)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text IS NULL OR lang = 'fr'")).count() == 0


def test_spills_hot_words_and_clashing_hashes(spark, rows, docs):
    tight = collocations.Limits(entries=200, container=4, vocabulary=9, partition=400, chunk=50, id_bits=3, shared=4)
    assert answer(collocations.collocations(docs, min_count=5, limits=tight)) == plain(rows, 5)
    twice = replace(tight, one_level=2, entries=900)
    assert answer(collocations.collocations(docs, min_count=5, limits=twice)) == plain(rows, 5)


def test_trie_counts_and_bursts():
    rng = np.random.default_rng(1)
    trie, truth = hattrie.HatTrie(4, 8), Counter()
    for _ in range(30):
        rows = (rng.geometric(0.3, (200, 4)) % 40).astype(">u4")
        truth.update(map(tuple, rows.tolist()))
        trie.add(rows)
    assert len(trie) == len(truth) and trie.depth() > 2
    assert all(trie.count(k) == n for k, n in truth.items())
    rows, counts = trie.spill(len(truth) // 3)
    assert len(trie) <= len(truth) // 3 and len(rows) == len({tuple(r) for r in rows.tolist()})
    rest, more = trie.entries()
    got = Counter(dict(zip(map(tuple, rows.tolist()), counts.tolist())))
    assert not got.keys() & set(map(tuple, rest.tolist()))
    got.update(dict(zip(map(tuple, rest.tolist()), more.tolist())))
    assert got == truth
    trie.add(np.array([[1, 2, 3, 4]] * 3, dtype=">u4"))
    assert trie.count((1, 2, 3, 4)) >= 3
