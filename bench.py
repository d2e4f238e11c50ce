"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from loomspan.plans import QUERIES
from loomspan.session import local_session

HEADLINE = (
    "page_tag_histogram", "page_links_resolved", "page_link_trackers", "page_sections", "page_slot_report", "page_computed_styles", "page_compiled_html", "page_structural_score",
    "content_hash_dedup", "doc_placeholder", "doc_summary", "turn_intent", "event_latency_histogram", "fixed_window_limiter", "rolling_quota", "sliding_window_limiter", "running_peak",
    "metric_stats_index_percentile", "corpus_metric_stats", "version_diff", "raster_volatility", "raster_ssim",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus)
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles and reads cold files
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "sum of headline queries, best of two runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
