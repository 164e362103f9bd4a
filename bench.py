"""Time the headline queries and print one JSON line.

Each query starts without kept intermediates, and the timing covers planning, execution and
the collection of its result. One unmeasured run of the flagship warms the JVM up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fixtures.catalog import QUERIES
from sieveline.plans.lineage import release

HEADLINE = (
    "retrieval_run", "web_chunks", "bm25_scores", "bm25_top_k", "select_context", "dense_rank",
    "method_comparison", "select_top_k", "select_mmr", "select_coverage", "select_joint",
    "select_exact", "source_hints", "routing_plans", "routing_summary", "daily_prices",
    "prior_close_evidence", "price_eligibility", "answer_verdicts", "reliability_replay",
    "dataset_profile", "record_violations", "outcome_scores", "disjoint_sample",
    "draft_review_violations", "prepared_requests",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sieveline-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    QUERIES["retrieval_run"](spark, folder).collect()
    seconds: dict[str, float] = {}
    for name in chosen:
        release(spark)
        began = time.perf_counter()
        QUERIES[name](spark, folder).collect()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
