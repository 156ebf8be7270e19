"""The ways taken for large or skewed inputs give the results of the simple ones."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusdetect.functions.tokens import characters
from corpusdetect.operators import evaluation as ev
from corpusdetect.operators import filters as flt
from corpusdetect.operators import grouping as gp
from corpusdetect.operators import ngram
from corpusdetect.operators import setops as so
from corpusdetect.plans import global_index, lookup_join, materialize, scratch_path, scratch_scope, shared_folder
from corpusdetect.schemas import PROBLEM_SCHEMA
from corpusdetect.sources import problems, stores
from corpusdetect.sources.catalog import Catalog
from corpusdetect.streaming import ingest


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    # A third of the big side has one key.
    big = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS k")
    small = spark.range(0, 40, 2).selectExpr("id AS k", "id * 10 AS v").unionByName(spark.createDataFrame([(0, 99)], "k long, v long"))
    plain = big.join(small, ["k"], how)
    wanted = sorted(map(tuple, plain.collect()), key=str)
    for salts in (1, 16):
        found = lookup_join(big, small, ["k"], how, max_rows=3, salts=salts)
        assert sorted(map(tuple, found.select(*plain.columns).collect()), key=str) == wanted


def test_global_index_is_consecutive(spark):
    values = [random.Random(7).randrange(10**9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in set(values)], "v long").repartition(7)
    found = {r.v: r["index"] for r in global_index(df, [F.desc("v")]).collect()}
    assert found == {v: i for i, v in enumerate(sorted(set(values), reverse=True))}


def brute(human, ai):
    return sum((a > h) + (a == h) / 2 for h in human for a in ai) / (len(human) * len(ai))


def test_auroc_with_one_hot_group_over_many_buckets(spark):
    rng = random.Random(1)
    data = [("hot", "m", rng.choice(["human", "g", "k"]), rng.randrange(400) / 8) for _ in range(3000)]
    data += [(f"d{i % 5}", "m", rng.choice(["human", "g"]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "Detector string, BaseModel string, Generator string, Value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(r.Detector, r.Generator): r.auroc for r in ev.auroc(df).collect()}
        curve = ev.roc_curve(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for (d, g), area in found.items():
        of = lambda name: [v for x, _, y, v in data if x == d and y == name]
        assert area == pytest.approx(brute(of("human"), of(g)))
        points = sorted((r.fpr, r.tpr) for r in curve if (r.Detector, r.Generator) == (d, g))
        trapezoid = sum((q[0] - p[0]) * (p[1] + q[1]) / 2 for p, q in zip(points, points[1:]))
        assert trapezoid == pytest.approx(area)
    assert len(found) == 7


def test_copies_of_one_text_are_one_row(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'copy' ELSE string(id) END AS t").repartition(6)
    kept = so.first_wins(df, [F.col("id")], F.col("t")).collect()
    assert len(kept) == 667 and min(r.id for r in kept if r.t == "copy") == 0


def test_rows_with_equal_order_keys_are_one_row(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "c"), (2, "c"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    kept = [tuple(r) for r in so.first_wins(df, [F.col("id")], F.col("t")).collect()]
    assert sorted(kept, key=str) == [(1, "a"), (1, "b"), (2, "c"), (3, None)]


def test_equal_solutions_in_two_spellings_of_a_language_are_one_sample(spark):
    rows = [("7", "d", {"python": "x = 1", "python3": "x = 1", "java": "int x = 1;"}), ("8", "d", {"python3": "x = 2"})]
    found = problems.from_problems(spark.createDataFrame(rows, PROBLEM_SCHEMA)).collect()
    assert sorted((r.id, r.Language, r.Code) for r in found) == [
        ("7", "java", "int x = 1;"), ("7", "python", "x = 1"), ("8", "python", "x = 2")]


def test_scores_do_not_depend_on_the_join_strategy(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "abcab"), (2, "b", "bbbac"), (3, "a", "x"), (4, "b", "")], "sample_id long, model string, Code string")
    counted = ngram.bigram_counts(df, ["sample_id", "model"], characters)
    models = ngram.train(counted, ("a", "b"))
    assert models.vocabulary_size == 4

    def statistics():
        rows = ngram.token_statistics(counted, models, pairs=[("a", "b")]).collect()
        return sorted((r.sample_id, r.model, r.model2 or "", r.n, round(r.logprob, 9), r["rank"]) for r in rows)

    sent = statistics()
    monkeypatch.setattr(ngram, "BROADCAST_ENTRIES", 0)
    assert statistics() == sent
    assert {r[0] for r in sent} == {1, 2, 3, 4}


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_cluster_session_needs_the_setting():
    class Context:
        master, applicationId = "spark://host:7077", "app-0"

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default=None):
            return self.folder or default

    class Session:
        sparkContext = Context()

    session = Session()
    session.conf = Conf("hdfs://shared/checkpoints/")
    assert shared_folder(session) == "hdfs://shared/checkpoints"
    session.conf = Conf(None)
    with pytest.raises(RuntimeError):
        shared_folder(session)


def test_problem_arrays(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": "7", "desc": "d", "solutions": {"python3": "x", "c++": "y"}}]')
    found = problems.from_problems(problems.read_problems(spark, str(tmp_path))).collect()
    assert sorted((r.Language, r.Code, r.id) for r in found) == [("cpp", "y", "7"), ("python", "x", "7")]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    row = ("human", "python", "x", None, None, None, "p", "p", 5, "d")
    stores.write_parquet(spark.createDataFrame([row], stores.SAMPLE_SCHEMA), path, partition_by=("Dataset",))
    df = stores.read_parquet(spark, path).filter("Dataset = 'd' AND Language = 'python'").select("Language")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Language), EqualTo(Language,python)]" in plan
    assert "PartitionFilters: [isnotnull(Dataset" in plan
    assert "ReadSchema: struct<Language:string>" in plan


def test_catalog_refuses_other_schemas(spark):
    catalog = Catalog()
    catalog.register("odd", lambda s: s.range(1))
    with pytest.raises(TypeError):
        catalog.load(spark, "odd")


def test_repeated_batches_do_not_duplicate(spark, tmp_path):
    store, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).repartition(4).write.parquet(store)
    schema = spark.range(1).schema
    for position in ("one", "two"):  # a lost checkpoint makes all batches run again
        ingest.score_stream(
            ingest.read_stream(spark, store, schema, 2), lambda b: b, target, str(tmp_path / position)
        ).awaitTermination()
    assert spark.read.parquet(target).count() == 20


def plain_groups(lengths, diff):
    out, anchor, group = {}, None, -1
    for n in sorted(set(lengths)):
        if anchor is None or n - anchor > (n * diff if isinstance(diff, float) else diff):
            anchor, group = n, group + 1
        out[n] = group
    return out


@pytest.mark.parametrize("diff", [0.25, 1.0, 0, 40])
def test_size_groups_by_pointers(spark, diff):
    rng = random.Random(3)
    lengths = [rng.randrange(1, 2000) for _ in range(250)] + [0, 0, 1]
    df = spark.createDataFrame([(n,) for n in [*lengths, None]], "length int").repartition(5)
    found = {r.length: r.size_group for r in gp.size_groups(df, "length", diff, fold_up_to=0).collect()}
    assert found == plain_groups(lengths, diff) | {None: None}
    assert gp.size_groups(df.limit(0), "length", diff, fold_up_to=0).count() == 0


def test_size_groups_of_a_million_lengths(spark):
    df = spark.range(1, 1_000_001).selectExpr("CAST(id AS int) AS length")
    groups = gp.size_groups(df, "length", 0.01).groupBy("size_group").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    found = sorted((r.size_group, r.low, r.high) for r in groups.collect())
    wanted = plain_groups(range(1, 1_000_001), 0.01)
    assert len(found) == max(wanted.values()) + 1
    assert all(wanted[low] == wanted[high] == g and wanted.get(high + 1, g + 1) == g + 1 for g, low, high in found)


@pytest.mark.parametrize("chosen", [flt.CHOSEN, 0])
def test_index_filter_numbers_keys_only(spark, monkeypatch, chosen):
    monkeypatch.setattr(flt, "CHOSEN", chosen)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.randrange(30), f"text {i}", i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, text string, row int, key string").repartition(4)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for span in (range(0, 200), range(10, 40), range(5, 60, 2), range(150, 400), range(300, 400)):
        got = [tuple(r) for r in flt.index(span, [F.col("a"), F.col("b")])(df).collect()]
        positions = [i for i in span if i < len(rows)]
        assert sorted(map(order, got)) == [sorted(map(order, rows))[i] for i in positions]
        assert len(set(got)) == len(got) and set(got) <= set(rows)
    last = [r.row for r in flt.index(range(0, 1), [F.col("row")], descending=True)(df).collect()]
    assert last == [199]


@pytest.mark.parametrize("listed", [so.REPEATED, 0])
def test_first_wins_keeps_any_columns(spark, monkeypatch, listed):
    monkeypatch.setattr(so, "REPEATED", listed)
    rows = [(1, "a", "k", 7, 1), (2, "a", "l", 8, 2), (2, "b", "m", 9, 3), (2, "b", "n", 9, 4), (3, "c", None, None, 5)]
    df = spark.createDataFrame(rows, "id bigint, t string, _key string, _row int, place int")
    kept = [tuple(r) for r in so.first_wins(df, [F.col("id")], F.col("t")).collect()]
    assert sorted(kept)[0] == rows[0] and sorted(kept)[2] == rows[4] and sorted(kept)[1] in rows[2:4] and len(kept) == 3


def test_scratch_tables_last_as_long_as_their_scope(spark):
    with scratch_scope():
        outer = materialize(spark.range(3))
        with scratch_scope():
            inner = scratch_path(spark)
            spark.range(5).write.parquet(inner)
            scratch_path(spark, "never-written")
            assert spark.read.parquet(inner).count() == 5
        assert not os.path.exists(inner) and outer.count() == 3
        left = outer.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(left)
    assert not os.path.exists(left)
