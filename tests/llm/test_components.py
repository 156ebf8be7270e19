"""Components of an edge table against a plain union-find."""

import random

import numpy as np
import pytest

from corpusdetect.llm import components
from corpusdetect.llm.components import by_least, clusters, merged, roots


def by_force(edges):
    name = {}

    def root(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            name[max(a, b)] = min(a, b)
    return {x: root(x) for x in name}


def answer(df):
    rows = df.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.component for r in rows}


def written(monkeypatch):
    """Names of the tables that the following calls write."""
    names = []
    monkeypatch.setattr(
        components, "materialize", lambda df, label, write=components.materialize: names.append(label) or write(df, label)
    )
    return names


@pytest.fixture
def batches(spark, monkeypatch):
    """Sets how many edges a task contracts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def put(rows):
        monkeypatch.setattr(components, "EDGES", rows)
        spark.conf.set(key, str(rows))

    yield put
    spark.conf.set(key, before)


def chance(seed):
    rng = random.Random(seed)
    return [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]


@pytest.mark.parametrize("edges", [chance(1), chance(2), [(0, i) for i in range(1, 200)], [(500, i) for i in range(200)], [(3, 3)], []])
@pytest.mark.parametrize("rows", [1, 512])
def test_components_equal_union_find(spark, batches, edges, rows):
    batches(rows)
    df = spark.createDataFrame([*edges, (None, 1), (1, None), *edges], "a bigint, b bigint").repartition(5)
    found = clusters(df)
    name = answer(found)
    assert all(name[x] == x for x in name.values())
    assert answer(by_least(found)) == by_force(edges)


def test_components_of_text(spark):
    edges = [("é", "b"), ("b", "😀"), ("x", "￿"), ("", "q")]
    df = spark.createDataFrame(edges, "a string, b string").repartition(3)
    assert answer(by_least(clusters(df))) == by_force(edges)


def test_later_edges_between_components(spark):
    first, later = [(1, 2), (3, 4), (5, 6), (7, 8)], [(4, 2), (9, 6), (10, 11)]
    found = clusters(spark.createDataFrame(first, "a bigint, b bigint"))
    name = answer(found)
    between = [(name.get(a, a), name.get(b, b)) for a, b in later]
    got = merged(found, clusters(spark.createDataFrame(between, "a bigint, b bigint")))
    assert answer(by_least(got)) == by_force(first + later)


def test_a_chain_in_order_of_its_ids_takes_few_rounds(spark, monkeypatch, batches):
    """Each vertex under the least of its neighbours shortens such a chain by one vertex a round."""
    batches(1)
    edges = [(i, i + 1) for i in range(400)]
    names = written(monkeypatch)
    assert set(answer(by_least(clusters(spark.createDataFrame(edges, "a bigint, b bigint")))).values()) == {0}
    assert names.count("names") < 20


def test_edges_of_a_task_are_contracted_before_they_are_shuffled(spark, monkeypatch):
    names = written(monkeypatch)
    df = spark.createDataFrame(chance(3), "a bigint, b bigint").coalesce(1)
    assert answer(by_least(clusters(df))) == by_force(chance(3))
    assert names.count("names") == 1


def test_roots():
    a, b = np.array([4, 2, 7, 0]), np.array([2, 3, 6, 0])
    assert roots(a, b, 8).tolist() == [0, 1, 2, 2, 2, 5, 6, 6]
    assert not roots(np.arange(9_999), np.arange(1, 10_000), 10_000).any()
