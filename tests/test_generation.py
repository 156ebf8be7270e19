"""Greedy paths and sampled draws against plain walks over small models."""

import random
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import pytest

from corpusdetect.operators import generation as gen

COUNTS = "model string, ctx string, token string, c bigint"


def model(seed, n, successors):
    rng = random.Random(seed)
    rows = {}
    for m in ("one", "two"):
        for i in range(n):
            for _ in range(rng.randrange(successors + 1)):
                rows[m, f"t{i}", f"t{rng.randrange(n)}"] = rng.choice([1, 1, 2, 3, 7])
    return [(*k, c) for k, c in rows.items()]


def greedy_walk(counts, m, at, budget):
    out = []
    while len(out) < budget:
        follow = [(-c, t) for x, ctx, t, c in counts if (x, ctx) == (m, at)]
        if not follow:
            break
        at = min(follow)[1]
        out.append(at)
    return out


@pytest.mark.parametrize("steps, jobs", [(8, 8), (1, 2), (2, 0)])
def test_greedy_paths_are_walks(spark, monkeypatch, steps, jobs):
    monkeypatch.setattr(gen, "FRONTIER_STEPS", steps)
    monkeypatch.setattr(gen, "FRONTIER_JOBS", jobs)
    data = model(4, 60, 2)
    # A chain that does not come back, longer than the frontier may go.
    data += [("one", f"c{i}", f"c{i + 1}", 1) for i in range(70)]
    counts = spark.createDataFrame(data, COUNTS)
    asked = [("one", "t1", 5), ("one", "t2", 0), ("one", "t3", 64), ("two", "t3", 17), ("two", "nowhere", 9), ("one", "c0", 70), ("one", "c2", 300)]
    asked += [("one", f"t{i}", 16) for i in range(20, 24)]
    found = {(r.model, r.ctx): r.tokens for r in gen.greedy_continuations(counts, spark.createDataFrame(asked, "model string, ctx string, need int")).collect()}
    for m, ctx, need in asked:
        assert found.pop((m, ctx), []) == greedy_walk(data, m, ctx, need)
    assert not found


def test_no_path_for_contexts_that_are_not_reached(spark):
    data = [("m", "a", "b", 1), ("m", "b", "c", 1), ("m", "c", "a", 1), ("m", "x", "a", 1), ("m", "y", "x", 5), ("n", "a", "y", 1)]
    greedy = gen.likeliest(spark.createDataFrame(data, COUNTS))
    starts = spark.createDataFrame([("m", "b"), ("k", "a")], "model string, ctx string")
    assert sorted(tuple(r) for r in gen.reachable(greedy, starts).collect()) == [("m", "a", "b"), ("m", "b", "c"), ("m", "c", "a")]
    paths = gen.greedy_continuations(spark.createDataFrame(data, COUNTS), spark.createDataFrame([("m", "b", 4)], "model string, ctx string, need int"))
    assert [tuple(r) for r in paths.collect()] == [("m", "b", ["c", "a", "b", "c"])]


def test_each_row_gets_its_budget(spark):
    data = [("m", "a", "b", 1), ("m", "b", "a", 1)]
    rows = [(1, "m", "a", 3), (2, "m", "a", 1), (3, "m", "b", 0), (4, "m", None, 2), (5, "m", "q", 2), (6, "z", "a", 2)]
    df = spark.createDataFrame(rows, "id int, model string, last string, budget int")
    found = {r.id: r.tokens for r in gen.continue_greedily(df, spark.createDataFrame(data, COUNTS)).collect()}
    assert found == {1: ["b", "a", "b"], 2: ["b"], 3: [], 4: [], 5: [], 6: []}


def plain_shape(counts, temperature, top_k, top_p):
    out = {}
    contexts = {(m, ctx) for m, ctx, _, _ in counts}
    for m, ctx in contexts:
        own = sorted(((-c, t) for x, y, t, c in counts if (x, y) == (m, ctx)))
        total = sum(-c for c, _ in own)
        weights = [((-c / total) ** (1 / temperature), t) for c, t in own][:top_k]
        mass, kept = sum(w for w, _ in weights), []
        for i, (w, t) in enumerate(weights):
            if i and top_p is not None and sum(x for x, _ in weights[:i]) / mass >= top_p - 1e-9:
                break
            kept.append((w, t))
        mass = sum(w for w, _ in kept)
        out.update({(m, ctx, t): w / mass for w, t in kept})
    return out


@pytest.mark.parametrize("setting", [(1.0, None, None), (0.7, 3, None), (1.3, None, 0.6), (0.97, 4, 0.95), (1.0, 1, 0.1), (1.0, None, 0.0)])
def test_shapes_from_histograms(spark, setting):
    data = model(9, 25, 12) + [("hot", "h", f"s{i:03}", 1) for i in range(200)] + [("hot", "h", "top", 300)]
    found = {(r.model, r.ctx, r.token): r.p for r in gen.sampling_shape(spark.createDataFrame(data, COUNTS), *setting).collect()}
    wanted = plain_shape(data, *setting)
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(p) for k, p in wanted.items())


def test_alias_tables_hold_the_probabilities(spark):
    data = model(5, 30, 9) + [("even", "e", t, 5) for t in "abcd"] + [("single", "s", "x", 3)] + [("steep", "z", f"z{i}", 2**i) for i in range(20)]
    shape = gen.sampling_shape(spark.createDataFrame(data, COUNTS))
    wanted = {(r.model, r.ctx, r.token): r.p for r in shape.collect()}
    slots = gen.alias_tables(shape).collect()
    mass, sizes = Counter(), Counter((m, ctx) for m, ctx, _ in wanted)
    for r in slots:
        assert 0 <= r.slot < r["size"] == sizes[r.model, r.ctx] and 0 <= r.keep <= 1 << 32
        assert r.token_size == (sizes.get((r.model, r.token)) or None) and r.other_size == (sizes.get((r.model, r.other)) or None)
        mass[r.model, r.ctx, r.token] += Fraction(r.keep, (1 << 32) * r["size"])
        mass[r.model, r.ctx, r.other] += Fraction((1 << 32) - r.keep, (1 << 32) * r["size"])
    assert len({(r.model, r.ctx, r.slot) for r in slots}) == len(slots) == len(wanted)
    for k, p in wanted.items():
        assert float(mass[k]) == pytest.approx(p, abs=1e-6)
    assert sum(mass.values()) == len(sizes)


def test_draws_by_joins_equal_draws_in_tasks(spark):
    data = model(6, 40, 6) + [("one", "stop", "end", 1)]
    shape = gen.sampling_shape(spark.createDataFrame(data, COUNTS), 0.9, 5, 0.95)
    rng = random.Random(2)
    rows = [(i, rng.choice(["one", "two", "none"]), rng.choice([*(f"t{j}" for j in range(40)), "stop", "missing", None]), rng.choice([0, 1, 5, 30])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, model string, last string, budget int")
    in_tasks = sorted((r.id, r.last or "", tuple(r.tokens)) for r in gen.continue_sampled(df, shape, ["id"]).collect())
    by_joins = sorted((r.id, r.last or "", tuple(r.tokens)) for r in gen.continue_sampled(df, shape, ["id"], max_rows=0).collect())
    assert in_tasks == by_joins and len(in_tasks) == len(rows)
    slots = {(r.model, r.ctx, r.slot): r for r in gen.alias_tables(shape).collect()}
    for (i, last, tokens), (_, m, start, budget) in zip(in_tasks, rows):
        at, walked = start, []
        while len(walked) < budget and (m, at, 0) in slots:
            place = int(sha256(f"{gen.SEED}|{i}|{len(walked)}".encode()).hexdigest()[:8], 16) * slots[m, at, 0]["size"]
            slot = slots[m, at, place >> 32]
            at = slot.token if place % (1 << 32) < slot.keep else slot.other
            walked.append(at)
        assert list(tokens) == walked and (last == (at or ""))


def test_draws_follow_the_probabilities(spark):
    data = [("m", "a", "x", 6), ("m", "a", "y", 3), ("m", "a", "z", 1)]
    shape = gen.sampling_shape(spark.createDataFrame(data, COUNTS))
    df = spark.range(6000).selectExpr("id", "'m' AS model", "'a' AS last", "1 AS budget")
    drawn = Counter(r.tokens[0] for r in gen.continue_sampled(df, shape, ["id"]).collect())
    assert all(abs(drawn[t] / 6000 - p) < 0.02 for t, p in (("x", 0.6), ("y", 0.3), ("z", 0.1)))
