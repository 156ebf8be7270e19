"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, filteraudit, hamming, langid, mixing, neardup, neighbours, packing, secretscan, simhash, tokencount, toxicity, warc
from .common import table, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, folder: run(tune(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_mix_sources", mixing.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_identify_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query("op3_near_duplicates", neardup.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


# Searches ask for the rows whose id is divisible by this.
QUERY_STEP = 50


@query("op4_hamming_top_k", hamming.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where(f"vec_id % {QUERY_STEP} = 0"))


@query("op5_score_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(f"vec_id % {QUERY_STEP} = 0"))


@query("op7_pack_documents")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokencount.model_path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)


@query("op8_scan_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


@query("op9_archive_pages", warc.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.capture_histories(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_count_tokens")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokencount.model_path("piece_bpe_32k.model")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), path)


@query("op11_mine_collocations", collocations.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_simhash_duplicates")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_audit_filters", filteraudit.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
