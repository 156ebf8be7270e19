"""SimHash near duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from __spark_entry__ import queries
from corpusdetect.llm import golay, simhash

DOCS = "doc_id bigint, text string, print string, key int, a int, component long, spot string"


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """By all pairs: for each place the least place it is connected with."""
    values = np.array(prints, dtype=np.uint64)
    name = list(range(len(values)))
    for i in range(len(values)):
        todo = [i] if name[i] == i else []
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(values ^ values[at]) <= 3).tolist():
                if name[j] > i:
                    name[j] = i
                    todo.append(j)
    return name


def expected(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    name = plain_components(prints)
    least = {}
    for n, r in zip(name, rows):
        if r[0] is not None:
            least[n] = min(r[0], least.get(n, r[0]))
    return sorted(((r[0], f"{p:016x}", least.get(n)) for r, p, n in zip(rows, prints, name)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_code_is_perfect_and_neighbours_share_codewords():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    near = golay.near_codewords(words)
    codewords = np.arange(1 << 12) << 11
    codewords = codewords ^ np.array([golay._remainder(int(c)) for c in codewords])
    assert min(np.bitwise_count(codewords[1:])) == 7
    for w, keys in zip(words[:300], near):
        far = np.bitwise_count(codewords ^ w)
        assert far[keys[0]] <= 3 and set(keys.tolist()) == set(np.flatnonzero(far <= 4).tolist())
    for places in [*combinations(range(23), 1), *combinations(range(23), 2)]:
        other = golay.near_codewords(words ^ sum(1 << p for p in places))
        assert (near[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()
        if len(places) == 1:
            assert (near[:, :1] == other).any(axis=1).all() and (near == other[:, :1]).any(axis=1).all()


def test_every_link_shares_a_key():
    rng = np.random.default_rng(2)
    for places in [*combinations(range(64), 1), *random.Random(3).sample([*combinations(range(64), 3)], 400), *combinations(range(0, 64, 3), 2)]:
        a = rng.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = a ^ np.uint64(sum(1 << p for p in places))
        (pa, ka), (pb, kb) = simhash.search_keys(a), simhash.search_keys(b)
        for i in range(20):
            assert set(ka[pa == i].tolist()) & set(kb[pb == i].tolist()), places


def test_fingerprints_equal_the_definition():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "two Words", "a b c", "É é ÀB c d\x1ce", "x " * 5000]
    texts += [" ".join(rng.choice(["ab", "CD", "ef", "ÿ", "😀"]) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_fingerprint_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 1009}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.fixture(scope="module")
def family():
    """Chains, dense balls and strangers."""
    rng = random.Random(7)
    flip = lambda p, n: p ^ sum(1 << x for x in rng.sample(range(64), n))
    out = [rng.getrandbits(64) for _ in range(300)]
    for centre in out[:10]:
        out += [flip(centre, rng.randrange(1, 4)) for _ in range(20)]
        chain = centre
        for _ in range(15):
            chain = flip(chain, 3)
            out.append(chain)
    crowd = rng.getrandbits(64)
    out += [crowd ^ (rng.getrandbits(5) | rng.getrandbits(4) << 40) for _ in range(300)]
    # A code of distance 3 inside the crowd's bits: links of exactly 3 bits only.
    out += [crowd ^ (x << 20 | (x * 7 % 8) << 30) for x in range(0, 64, 3)]
    return sorted(set(out))


@pytest.mark.parametrize("bucket", [1024, 20, 2])
def test_links_connect_what_all_pairs_do(spark, family, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    values = np.array(family, dtype=np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "print bigint")).collect()
    place = {v: i for i, v in enumerate(values)}
    name = list(range(len(values)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
        a, b = root(place[r.a]), root(place[r.b])
        name[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(values))] == plain_components(family)


def test_awkward_rows(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(400)) for _ in range(5)]
    texts = [None, "", " \n", "One", "one", "two words", *base, *[b + " tail" for b in base], base[0].upper(), "x " * 60_000]
    rows = [(i, t, "p", i, i, i, "s") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base[1], None, None, None, None, None), (None, "alone in this", None, None, None, None, None), (None,) * 7]
    df = spark.createDataFrame(rows, DOCS)
    assert answer(simhash.near_duplicates(df)) == expected(rows)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = answer(queries()["op12_simhash_duplicates"](spark, folder))
    assert got == expected([tuple(r) for r in rows])
    assert len({r[2] for r in got}) < len(rows)
