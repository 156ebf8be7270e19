"""What a task holds, moves or writes does not grow faster than the input."""

import glob
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusdetect.functions.tokens import words
from corpusdetect.operators import ngram
from corpusdetect.plans import parts_for, scratch_scope, slices, storage
from corpusdetect.plans.storage import setting
from corpusdetect.queries import QUERIES, source_queries
from corpusdetect.queries.generation_queries import _arrived
from corpusdetect.schemas import DETECTION_SCHEMA, SAMPLE_SCHEMA
from corpusdetect.sources import connector, stores
from corpusdetect.streaming import ingest

TEXTS = [(1, "a", "abcab"), (2, "b", ""), (3, "a", None), (4, "b", "x"), (5, "a", "\U0001f600\u00e9\n \U0001f600\u00e9"), (6, "b", "aa aa b aa aa")]


def brute(texts):
    found = Counter()
    for sample, model, tokens in texts:
        found.update((sample, model, a, b) for a, b in zip([None, *tokens], tokens or [None]))
    return found


def rows(batches):
    return Counter({(r["sample_id"], r["model"], r["ctx"], r["token"]): r["n"] for b in batches for r in b.to_pylist()})


def test_bigrams_are_counted_in_stretches(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*TEXTS)], ["sample_id", "model", "_taken"])
    listed = [(s, m, list(t or "")) for s, m, t in TEXTS]
    tokens = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([None if t is None else list(t) for _, _, t in TEXTS])], batch.schema.names)
    for at_once in (1, 6, 10_000):
        monkeypatch.setattr(ngram, "TOKENS_AT_ONCE", at_once)
        monkeypatch.setattr(ngram, "ROWS_AT_ONCE", max(2, at_once))
        assert rows(ngram._counted([batch.slice(0, 0), batch])) == rows(ngram._counted([tokens])) == brute(listed)
    df = spark.createDataFrame(TEXTS, "sample_id long, model string, Code string")
    counted = ngram.bigram_counts(df, ["sample_id", "model"], words)
    found = Counter({(r.sample_id, r.model, r.ctx, r.token): r.n for r in counted.collect()})
    assert found == brute([(s, m, (t or "").split()) for s, m, t in TEXTS])


def test_counts_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram, "COUNTS_PER_FILE", 50)
    df = spark.range(0, 40, 1, 8).selectExpr("id AS sample_id", "'m' AS model", "'abcdefghijklmnopqrstuvwxyz' AS Code")
    counted = ngram.bigram_counts(df, ["sample_id", "model"])
    assert len(counted.inputFiles()) >= 40 * 26 // 50 and counted.count() == 40 * 26


def test_copies_of_long_texts_take_little_room_in_a_sliced_store(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "store")
    texts = [rng.randbytes(100_000).hex() for _ in range(12)]
    data = [("human", "python", t, None, None, None, "p", "p", i, f"d{k % 2}") for t in texts for i, k in enumerate(range(8))]
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    stores.write_parquet(spark.createDataFrame(data, SAMPLE_SCHEMA).coalesce(1), path, partition_by=("Dataset",))
    assert spark.conf.get(setting) == before
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in spark.read.parquet(path).inputFiles())
    assert size < 2 * 12 * 100_000 * 1.5  # each text once a slice, and not four times
    assert sorted(r.Code for r in stores.read_parquet(spark, path).collect()) == sorted(t for t in texts for _ in range(8))


def test_stores_of_streams_have_as_many_files_as_the_input_has_parts(spark, tmp_path):
    assert parts_for(spark.range(0, 100, 1, 23), 4) == 24 and parts_for(spark.range(0, 100, 1, 1), 4) == 4
    assert _arrived(spark.range(0, 100, 1, 9), str(tmp_path / "s"), 2) == 10
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_a_source_may_give_arrow_batches(spark, tmp_path):
    row = ("human", "python", "x", None, 0.5, None, "p", "p", 5, "d")
    spark.createDataFrame([row] * 700, SAMPLE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "f"))
    source = source_queries.FolderSource({"path": f"file://{tmp_path}/f"})
    batches = list(source.read(0, 1))
    assert all(isinstance(b, pa.RecordBatch) and len(b) <= 256 for b in batches) and sum(map(len, batches)) == 700
    connector.register(spark, source_queries.FolderSource)
    found = connector.read_source(spark, source.tag, path=f"file://{tmp_path}/f").collect()
    assert [tuple(r) for r in found] == [row] * 700


def test_xml_references_and_broken_characters(spark):
    # A character that no parser takes, one that is only discouraged, references in references, one behind the element.
    values = ["\x01a &amp;lt; &#10;b\u201cc", "\x7fq", "&amp;amp;", "&#65;&lt;", "\x01\x7f\ufffe\U0001f600&quot;", "", "a;b&gt;;&apos;"]
    lines = [f'  <sample Prompt="{i}" Code="{v}" />' for i, v in enumerate(values)] + ['<sample Prompt="7" Code="z" />\x01', '<sample Prompt="8" Code="&nope;" />']
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    found = {r.Prompt: r.Code for r in stores.parse_lines(df).collect()}
    assert found == {"1": "\x7fq", "2": "&amp;", "3": "A<", "4": "   \U0001f600\"", "5": "", "6": "a;b>;'", "7": "z"}
    assert sorted(r.value.split('"')[1] for r in stores.broken_lines(df).collect()) == ["0", "8"]


def test_filters_do_not_parse_lines_again(spark):
    df = spark.createDataFrame([('<sample Prompt="1" Code="z" />',)], "value string")
    shown = stores.parse_lines(df).filter("Prompt = '1'").select("Code")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" in shown and not [x for x in shown.split("\n") if "Filter" in x and "from_xml" in x]


def test_converted_xml_is_compressed(spark, tmp_path):
    first, second, third = (str(tmp_path / x) for x in "abc")
    text = random.Random(2).randbytes(2000).hex()
    data = [("human", "python", text, 1, 0.5, None, text, text, 5, "d")] * 50
    stores.write_parquet(spark.createDataFrame(data, SAMPLE_SCHEMA).coalesce(1), first)
    stores.convert(spark, first, "parquet", second)
    stores.convert(spark, second, "xml", third)
    assert sum(os.path.getsize(f"{second}/{f}") for f in os.listdir(second)) < 50 * 3 * len(text) / 3
    assert [tuple(r) for r in stores.read_parquet(spark, third).collect()] == data


def documents(spark, folder):
    """A table in four parts with repeated and missing keys, and how many samples differ."""
    rows = [(i % 90 if i % 11 else None, f"text {i % 90} " * 40, "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return len(set(rows))


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_dedupe_two_runs"])
def test_streams_give_back_what_they_have_read(spark, tmp_path, monkeypatch, name):
    different, arrivals = documents(spark, tmp_path), []
    arrived = lambda rows, store, least: arrivals.append(rows.count()) or _arrived(rows, store, least)
    monkeypatch.setattr("corpusdetect.queries.generation_queries._arrived", arrived)
    with scratch_scope():
        before = len(storage._SCRATCH)
        found = [r.hash for r in QUERIES[name](spark, str(tmp_path)).collect()]
        made = [p.removeprefix("file://") for p in storage._SCRATCH[before:]]
        files = {p: glob.glob(f"{p}/**/*.parquet", recursive=True) for p in made}
    assert len(found) == len(set(found)) == different
    assert len(arrivals) >= 4 and max(arrivals) < 300  # not all at once
    assert not [p for p, inside in files.items() if inside and ("/store-" in p or "/batch-" in p)]


def test_a_stream_is_shuffled_once_on_its_way_to_the_folders(spark):
    rows = spark.createDataFrame([("ab", "hab", "x"), ("cd", "hcd", "y")], "hash string, prefix string, Code string")
    stored = spark.createDataFrame([("ab", "hab", "r")] * 2, "hash string, prefix string, run string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, ingest._DEALT_ALIKE, "false"):
        new = ingest.new_hashes(rows, stored)
        shown = new._jdf.queryExecution().executedPlan().toString()
        assert [r.Code for r in new.collect()] == ["y"]
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", shown)
    assert len(dealt) == 2 and all(re.fullmatch(r"prefix#\d+", d) for d in dealt)


def test_slices_hold_every_row_once(spark):
    rows = spark.range(0, 100, 1, 3).select(F.when(F.col("id") % 7 > 0, F.col("id") % 20).alias("key"), "id")
    parts = [[r.id for r in part.collect()] for part in slices(rows, F.col("key"))]
    assert len(parts) == 3 and sorted(sum(parts, [])) == list(range(100))
    assert len(slices(rows.coalesce(1), F.col("key"))) == 1


def test_detections_keep_a_text_once_a_row_group(spark, tmp_path):
    rng = random.Random(3)
    texts = [rng.randbytes(1000).hex() for _ in range(2000)]
    data = [("p", "c", "python", 0.5, 1, "rank", "human", b, None, t, None, None, None, 5, "d") for t in texts for b in "abcd"]
    stores.write_parquet(spark.createDataFrame(data, DETECTION_SCHEMA).coalesce(1), str(tmp_path), "detection", ("Detector",))
    (file,) = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)
    group = pq.ParquetFile(file).metadata.row_group(0)
    (code,) = [c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "Code"]
    assert group.num_rows == len(data) and code.total_uncompressed_size < 1.2 * sum(map(len, texts))


def test_the_detection_job_joins_texts_a_part_at_a_time(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path)
    keyed, write, parts = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id IS NOT NULL").count(), stores.write_parquet, []
    monkeypatch.setattr(stores, "write_parquet", lambda rows, *a, **b: parts.append(rows.count()) or write(rows, *a, **b))
    with scratch_scope():
        before = len(storage._SCRATCH)
        found = QUERIES["detection_job"](spark, str(tmp_path)).count()
        made = [p.removeprefix("file://") for p in storage._SCRATCH[before:]]
    assert found == 18 * keyed == sum(parts) and len(parts) >= 4 and max(parts) < found
    assert not [p for p in made if "/bigrams-" in p]  # gone when all was scored
