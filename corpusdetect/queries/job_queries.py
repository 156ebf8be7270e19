"""The detection job from samples to curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import FLIPPED
from ..operators import detectors as det
from ..operators import evaluation as ev
from ..plans.storage import scratch_path, scratch_scope, shuffles_dropped, slices
from ..schemas import DETECTION_SCHEMA
from ..sources import stores
from .detection_queries import _ALL, _BOTH, _SHORT, RUN_TIME, _scores
from .evaluation_queries import areas, scored
from .registry import query, r6, sql6
from .views import SAMPLE_HASH, samples, sql

_FULL = f"""SELECT sample_id, sha256(OriginalPrompt) AS PromptHash, {SAMPLE_HASH} AS CodeSampleHash, Language, Value,
    CAST(512 AS INTEGER) AS MaxLength, Detector, Generator, BaseModel, SecondaryModel, Code, TopK, TopP, Temperature,
    CAST({RUN_TIME} AS BIGINT) AS Date, Dataset FROM samples JOIN scores USING (sample_id)"""


def _stored(spark, folder):
    """Every detector, model and pair over all samples: scored, written as a store, read again."""
    path, scored_path = scratch_path(spark, "detection"), scratch_path(spark, "scores")
    with shuffles_dropped(spark):
        with scratch_scope():  # counts of bigrams go when all is scored
            scores = _scores(spark, folder).withColumn("Value", r6("Value"))
            scores.write.parquet(scored_path)
        scores = spark.read.schema(scores.schema).parquet(scored_path)
        for part in slices(samples(spark, folder), F.col("sample_id")):  # texts are shuffled a part at a time
            rows = det.to_detections(part, scores, RUN_TIME, 512)
            stores.write_parquet(rows, path, "detection", partition_by=("Detector",))
    return stores.read_store(spark, path, "parquet", "detection")


@query("detection_job", sql("samples", *_BOTH, ("short", _SHORT), ("scores", _ALL), ("full_rows", _FULL),
       select=f"SELECT {', '.join(DETECTION_SCHEMA.names)} FROM full_rows"))
def detection_job(spark, folder):
    return _stored(spark, folder).select(*DETECTION_SCHEMA.names)


@query("auroc_of_detections", sql("samples", *_BOTH, ("short", _SHORT), ("scores", _ALL), ("full_rows", _FULL),
       ("scored", scored("full_rows")), ("areas", areas()),
       select=f"SELECT Detector, BaseModel, Generator, n_human, n_ai, {sql6('auroc')} AS auroc FROM areas"))
def auroc_of_detections(spark, folder):
    """AUROCs of stored scores, nearly all of them different."""
    return ev.auroc(_stored(spark, folder), flip=FLIPPED).withColumn("auroc", r6("auroc"))
