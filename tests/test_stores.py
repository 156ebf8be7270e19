"""Stores that grow: sketches, buckets, prefixes, and batches from several checkpoints."""

import glob
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from corpusdetect.operators import filters
from corpusdetect.plans import materialize, sketch
from corpusdetect.schemas import SAMPLE_SCHEMA
from corpusdetect.sources.bucketed import BucketedStore
from corpusdetect.streaming import ingest


def hashes(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [sketch.BROADCAST_BLOCKS, 0])
def test_sketch_lets_all_its_values_pass_and_few_others(spark, monkeypatch, limit):
    monkeypatch.setattr(sketch, "BROADCAST_BLOCKS", limit)
    known = hashes(spark, 0, 4000)
    made = sketch.bloom_sketch(known, "hash", sketch.blocks_for(4000))
    assert sketch.may_contain(known, made, "hash").count() == 4000
    passed = sketch.may_contain(hashes(spark, 10_000, 30_000), made, "hash").count()
    assert passed < 600
    assert sketch.may_contain(known, made.limit(0), "hash").count() == 0


def test_sketches_of_parts_merge_to_that_of_the_whole(spark, tmp_path):
    path, blocks = str(tmp_path / "s"), sketch.blocks_for(900)
    for low in (0, 300, 600):
        sketch.write_sketch(hashes(spark, low, low + 300), "hash", path, blocks)
    merged = sketch.read_sketch(spark, path)
    whole = sketch.bloom_sketch(hashes(spark, 0, 900).union(spark.createDataFrame([(None,)], "hash string")), "hash", blocks)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(merged) == rows(whole)


def test_only_rows_that_pass_the_sketch_reach_the_shuffle(spark):
    df = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    known = hashes(spark, 0, 50)
    made = materialize(sketch.bloom_sketch(known, "hash", sketch.blocks_for(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = filters.distribution(known, F.col("h"), made)(df)
        assert sorted(r.id for r in kept.collect()) == list(range(50))
        shown = plan(kept).split("Initial Plan")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The exact join's exchange stands above the broadcast join with the sketch.
    exact = re.search("SortMergeJoin|ShuffledHashJoin", shown)
    assert exact, shown
    assert exact.start() < shown.index("Exchange hashpartitioning") < shown.index("BroadcastHashJoin")
    assert sketch.may_contain(df.withColumnRenamed("h", "hash"), made, "hash").count() < 250


def test_joins_with_a_bucketed_store_do_not_move_it(spark, tmp_path):
    store = BucketedStore(spark, f"t{uuid.uuid4().hex}", str(tmp_path / "t"), "hash", 4)
    rows = hashes(spark, 0, 500).withColumn("model", F.when(F.col("hash") < "8", F.lit("m")))
    assert store.missing(rows).count() == 500
    store.append(rows.where("hash < 'c'"))
    first = store.read().count()
    store.add_missing(rows)
    store.add_missing(rows.union(rows))
    assert store.read().count() == 500 and 0 < first < 500
    left = store.missing(hashes(spark, 400, 600))
    assert left.count() == 100
    shown = plan(left)
    stored = shown[shown.index("SortMergeJoin"):].split("FileScan")[-1]
    assert "Bucketed: true" in stored or "SelectedBucketsCount: 4 out of 4" in stored
    assert len(re.findall(r"Exchange hashpartitioning", shown.split("Initial Plan")[0])) == 1
    # Nulls in further columns are equal.
    other = rows.withColumn("model", F.lit(None).cast("string"))
    assert store.missing(other, ["hash", "model"]).count() == rows.where("model IS NOT NULL").count()
    with pytest.raises(ValueError):
        store.missing(rows, ["model"])
    store.drop()


def samples(spark, low, high):
    row = lambda i: ("human", "python", f"x = {i}", None, None, None, "p", "p", 5, "d")
    return spark.createDataFrame([row(i) for i in range(low, high)], SAMPLE_SCHEMA)


def append(spark, rows, target, position, folder):
    rows.repartition(2).write.parquet(folder)
    ingest.append_unique(ingest.read_stream(spark, folder), target, position).awaitTermination()


def test_two_checkpoints_into_one_store_lose_nothing(spark, tmp_path):
    target = str(tmp_path / "target")
    for name, low, high in (("a", 0, 50), ("b", 30, 200), ("c", 0, 200)):
        append(spark, samples(spark, low, high), target, str(tmp_path / f"at-{name}"), str(tmp_path / name))
    stored = spark.read.parquet(target)
    assert stored.count() == stored.select("hash").distinct().count() == 200
    assert stored.select("run").distinct().count() == 2  # the third had nothing new


def test_a_batch_opens_only_folders_of_its_prefixes(spark, tmp_path):
    target = str(tmp_path / "target")
    append(spark, samples(spark, 0, 400), target, str(tmp_path / "one"), str(tmp_path / "a"))
    new = samples(spark, 399, 402)
    own = {"h" + r.h[:2] for r in new.select(ingest.sample_row_hash().alias("h")).collect()}
    broken = 0
    for file in glob.glob(f"{target}/run=*/batch=*/prefix=*/*.parquet"):
        if re.search("prefix=(...)/", file)[1] not in own:
            with open(file, "r+b") as f:  # an opened file would fail the batch
                f.write(b"no!!")
                f.seek(-8, 2)
                f.write(b"\xff" * 8)
            broken += 1
    assert broken > 100
    append(spark, new, target, str(tmp_path / "two"), str(tmp_path / "b"))
    stored = spark.read.schema("Code string, run string, batch int, prefix string").parquet(target)
    assert stored.where(F.col("prefix").isin(*own)).where("Code IN ('x = 399', 'x = 400', 'x = 401')").count() == 3


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    target, store, position = (str(tmp_path / x) for x in ("target", "in", "at"))
    samples(spark, 0, 20).repartition(1).write.parquet(store)
    for _ in range(2):
        ingest.append_unique(ingest.read_stream(spark, store), target, position).awaitTermination()
        for done in os.listdir(f"{position}/commits"):  # as if the run had ended before the commit
            if "metadata" not in done:
                os.remove(f"{position}/commits/{done}")
    assert spark.read.parquet(target).count() == 20


def test_stored_scores_are_not_computed_again(spark, tmp_path):
    target, store = str(tmp_path / "target"), str(tmp_path / "in")
    spark.range(30).repartition(3).write.parquet(store)
    seen = []

    def score(batch):
        seen.append(batch.count())
        return batch.withColumn("Value", F.col("id") * 2)

    for position in ("one", "two"):
        stream = ingest.read_stream(spark, store, spark.range(1).schema, 2)
        ingest.score_stream(stream, score, target, str(tmp_path / position), ["id"]).awaitTermination()
    assert spark.read.parquet(target).count() == 30 and sum(seen) == 30
