"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from terrasift.plans.catalogue import QUERIES
from terrasift.session import build_session

HEADLINE = (
    "keyed_filter", "priority_list_table", "nearby_search", "community_radius_search", "map_payload_rows",
    "community_area_search", "band_summary", "district_stats", "nearest_feature_by_district", "radius_counts", "cross_split_leakage_drops",
    "point_in_polygon", "priority_rank_and_bands", "rule_signals", "screen_ranked_sites",
    "suppress_overlapping_boxes", "best_overlap_matches", "near_duplicate_components", "visit_changes",
    "report_rate_limit", "best_pixel_alignment",
)
REPEATS = 2  # after one run that warms up


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    repeats = int(os.environ.get("BENCH_REPEATS", REPEATS) or 1)
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        best = None
        # The best of a few warm runs; planning jobs and written stages count every time.
        for attempt in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if attempt:
                best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
