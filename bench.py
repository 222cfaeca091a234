"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomtrail.plans import catalog

HEADLINE = (
    "tool_usage_profile", "longest_identical_streak", "error_recovery", "context_running_total", "verification_after_last_change", "first_divergence",
    "collection_rollup", "signal_prevalence", "reward_stats", "failed_check_effect", "task_collection_matrix", "floor_quantiles", "token_estimate",
    "reward_prefix_match", "manifest_span_join", "latest_review_per_head", "flagged_semi", "episode_roots", "episode_summary", "phrase_search_bm25",
    "duplicate_paragraphs", "data_card", "step_alignment", "artifact_replay", "event_sessions",
)


def main() -> None:
    # for the Python workers, wherever this is started from
    os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(min(took), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
