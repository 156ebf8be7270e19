"""Cases at the edge that the operators of the first round handle: each against a plain form."""

import math
import random
import re
import time

import numpy as np
import pytest

from corpusdetect.llm import langid, neardup, neighbours, secretscan, toxicity
from corpusdetect.llm.automaton import Automaton


def plain_text(rng, n, vowels="aeiou"):
    return " ".join("".join(rng.choice("bdfglmnprst") + rng.choice(vowels) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(1)
    ordinary = [plain_text(rng, 60) for _ in range(150)]
    toxic = [plain_text(rng, 30) + f" {rng.choice(['quwizzkox', 'vexjaqqle'])} " + plain_text(rng, 30) for _ in range(150)]
    return toxicity.fit([(t, 0) for t in ordinary] + [(t, 1) for t in toxic])


@pytest.mark.parametrize("word", ["quwizzkox", "vexjaqqle"])
def test_a_marking_word_counts_wherever_it_stands(toxic_model, word):
    rest = plain_text(random.Random(2), 41)
    texts = [word, f"{rest} {word}", f"{word} {rest}", f"{rest} {word} {rest}", f"{rest} {word}.", f"{rest}\n{word}"]
    found = toxicity.evidence(texts, toxic_model)
    assert toxic_model.marks and (found > toxic_model.threshold).all(), found
    for n in range(38, 100):  # wherever the last window begins
        text = "x" * n + " " + word
        assert toxicity.evidence([text], toxic_model)[0] > toxic_model.threshold
    assert (toxicity.evidence([rest, "", None], toxic_model) == 0).all()


def test_without_marks_windows_are_the_evidence():
    rng = random.Random(3)
    ordinary = [plain_text(rng, 60, "ae") for _ in range(120)]
    # No word or part of one is shared by many, but the letters are others.
    toxic = ["".join(rng.choice("ouywvxzqjk ") for _ in range(400)) for _ in range(120)]
    model = toxicity.fit([(t, 0) for t in ordinary] + [(t, 1) for t in toxic])
    if model.marks:
        model = toxicity.replace(model, marks=False, toxic=toxicity._trained([t.encode() for t in toxic], 1 << 16))
    found = toxicity.evidence([plain_text(rng, 60, "ae"), "".join(rng.choice("ouywvxzqjk ") for _ in range(400))], model)
    assert found[1] > found[0]


def test_window_lengths_are_those_of_plain_calls(toxic_model):
    import zstandard

    text = plain_text(random.Random(4), 50).encode()
    starts = np.arange(0, len(text), 40)
    sizes = np.minimum(64, len(text) - starts)
    options = zstandard.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    for content in (b"", toxic_model.ordinary, toxic_model.toxic):
        dictionary = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
        plain = [len(zstandard.ZstdCompressor(compression_params=options, **dictionary).compress(text[a : a + n])) for a, n in zip(starts, sizes)]
        assert toxicity._lengths(content, text, starts, sizes).tolist() == plain


def test_vectors_whose_squares_vanish(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(6)]) for i, scale in enumerate([1, 1e-200, 1e-310, 1e200, 1, 1e-170, 1] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 5 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for query in range(0, len(rows), 5):
        scores = sorted(((-float(unit[query] @ v), i) for i, v in unit.items() if i != query))[:5]
        found = sorted(got[query])
        assert [f[1] for f in found] == [i for _, i in scores]
        assert all(math.isclose(f[2], -s, abs_tol=1e-9) for f, (s, _) in zip(found, scores))


def test_long_runs_that_begin_again_and_again_are_scanned_once():
    scanner = secretscan.Scanner(secretscan.RULES)
    took = []
    for n in (40_000, 350_000):
        text = b"eyJ" * n + b" " + b"eyJabcdefgh1.eyJabcdefgh2.sig " + b"eyJ" * 100
        start = time.perf_counter()
        spans = scanner.spans([text])[0]
        took.append(time.perf_counter() - start)
        assert [s for s in spans if secretscan.RULES[s[1]].kind == "jwt"] == [(3 * n + 1, 6, 3 * n + 30)]
    assert took[1] < 15 * max(took[0], 0.05)


def test_backwards_starts_equal_regexes():
    rng = random.Random(6)
    rule = r"eyJ[a-c_-]{3,}\.eyJ[a-c_-]{3,}\.[a-c_-]+"
    own = Automaton([rule], anywhere=False).prepare(rule)
    for _ in range(400):
        text = "".join(rng.choice(["eyJ", "a", "b", "_", ".", "eyJab", "abc.", " ", "é"]) for _ in range(rng.randrange(60))).encode()
        assert own.leftmost(text) == [m.span() for m in re.finditer(rule.encode(), text)]


def test_repeated_and_missing_ids_keep_all_columns(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(1, text(1), 7, "a"), (1, text(2), 8, "b"), (1, None, 9, "n"), (2, text(3), 1, "c"), (2, text(3), 1, "c")]
    rows += [(None, text(4 + i), i, "x") for i in range(3)] + [(None, None, 0, None), (5, text(1), 3, "copy")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __n int, row string")
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert [r for r in got if r[0] is None] == sorted([r for r in rows if r[0] is None], key=str)
    assert sorted(r[0] for r in got if r[0] is not None) == [1, 2]
    assert (2, text(3), 1, "c") in got and all(r in rows for r in got)


def test_language_ids_may_be_text(spark):
    rng = random.Random(7)
    rows = [(f"id-{i}", plain_text(rng, 20, "ae" if i % 2 else "ou"), "xx" if i % 2 else "yy") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    found = langid.identify(df, langid.train(df)).collect()
    assert len(found) == 120 and sum(r.lang_pred == ("xx" if int(r.doc_id[3:]) % 2 else "yy") for r in found) > 110


def test_kernel_regression_equals_the_full_solution():
    """With as many landmarks as rows, the fitted values are those of the ridge solved on the whole kernel."""
    rng = random.Random(8)
    rows = [(plain_text(rng, 12, "ae" if i % 2 else "ou"), "xx" if i % 2 else "yy") for i in range(30)]
    model = langid.fit(rows, landmarks=30)
    kernel = np.zeros((30, 30))
    sets = [set(langid.sequences_of(t).tolist()) for t, _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            kernel[i, j] = len(a & b) / math.sqrt(len(a) * len(b))
    order = [i for lang in ("xx", "yy") for i, r in enumerate(rows) if r[1] == lang]
    held = kernel[np.ix_(order, order)]
    spread, axes = np.linalg.eigh(held)
    useful = spread > 1e-6 * spread.max()
    target = np.array([[1.0 if r[1] == lang else -1.0 for lang in ("xx", "yy")] for r in rows])
    features = kernel[:, order] @ (axes[:, useful] / np.sqrt(spread[useful]))
    share = np.full((30, 1), 1 / 15)
    gram = features.T @ (features * share) + langid.RIDGE * np.eye(features.shape[1]) / features.shape[1]
    wanted = features @ np.linalg.solve(gram, features.T @ (target * share))
    slots = langid._slots(model.sequences)
    got = langid._kernel([t for t, _ in rows], slots, model.presence) @ model.weights
    assert np.allclose(got, wanted, atol=1e-2)


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    from corpusdetect.llm.tokencount import model_path
    from corpusdetect.llm.wordids import WordIds

    path = model_path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(9)
    library.no_truncation()
    library.no_padding()
    parts = ["a", "Word", " ", " ", " ", "  ", "\n", "\t", "é", "　", "\x85", "\x1c", "'s", "don't", "1234", "😀", "<|endoftext|>", "x" * 70, "\xa0", "​"]
    texts = ["", " ", "\n", "a\n", " a", "a ", "b a\n", "x\ny z", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500))]
    encoder = WordIds(path)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.ids(texts)):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_chunks_without_a_space_are_composed_in_few_rounds(monkeypatch):
    import sentencepiece

    from corpusdetect.llm.tokencount import model_path
    from corpusdetect.llm.transducer import CountTransducer

    path, rng = model_path("piece_bpe_32k.model"), random.Random(10)
    library, transducer = sentencepiece.SentencePieceProcessor(model_file=path), CountTransducer(path)
    syllables = ["the", "an", "re", "ing", "st", "é", "o", "q", "1", "ab", "er"]
    texts = ["".join(rng.choice(syllables) for _ in range(n)) for n in (20_000, 3, 900, 40_000)]
    texts += ["a" * 50_000, "ab" * 20_000, "a" * 383 + " " + "b" * 5000, " ".join(["word"] * 400)]
    calls, run = [], transducer._run
    monkeypatch.setattr(transducer, "_run", lambda *a: calls.append(len(a[3])) or run(*a))
    assert transducer.counts(texts).tolist() == [len(library.encode(t)) for t in texts]
    assert len(calls) < 30 and max(calls) > 100


@pytest.mark.parametrize("rows", [3, 25, 100_000])
def test_runs_are_cut_at_borders_and_merged_in_order(spark, rows):
    from corpusdetect.llm import warc
    from corpusdetect.plans import materialize

    rng = random.Random(11)
    captures = []
    for run in range(6):
        own = [(f"com,{rng.choice('aab')})/", f"2024-{rng.randrange(3):02}", rng.choice([None, *range(20)]), f"file{run}", 10 * i, "response", i, "d", None) for i in range(40)]
        captures += sorted(own, key=warc._order)
    df = materialize(spark.createDataFrame(captures, warc._CAPTURE).repartition(5, "path").sortWithinPartitions("path", "url_key", "captured", "page_id"))
    # Files hold nulls first here, so runs are broken up where they are not in order.
    merged = [tuple(r) for r in warc.merge_runs(df, rows).collect()]
    assert merged == sorted(captures, key=warc._order)
    assert warc.merge_runs(materialize(df.limit(0)), rows).count() == 0
