"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the cores. Each
query is run once to completion after a small warm-up of the session; results
are consumed by a sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from corpusdetect.plans import scratch_scope
from corpusdetect.queries import QUERIES
from corpusdetect.session import local_session

HEADLINE = (
    "auroc_by_detector",
    "auroc_white_box",
    "roc_curve_points",
    "heatmap_by_dataset",
    "diff_languages",
    "token_frequency",
    "token_top15",
    "detections_all",
    "detector_loglikelihood",
    "detector_binoculars",
    "dedupe_first_wins",
    "filter_distribution",
    "size_groups_relative",
    "paging",
    "sample_hash",
    "prompt_formats",
    "xml_round_trip",
    "parquet_round_trip",
    "source_problem_json",
    "generation_job",
    "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with scratch_scope():
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
