"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS choose data and cores; BENCH_QUERIES (comma separated,
or "all") other queries. Each query runs to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from readloom.plans.catalog import all_queries
from readloom.session import build_session

HEADLINE = (
    "fasta_round_trip",
    "base_composition",
    "sequence_hash",
    "read_index",
    "longest_n",
    "longest_to_coverage",
    "interval_distance",
    "well_summary",
    "gap_histogram",
    "minhash_sketch",
    "best_match",
    "screen",
    "attach_samples",
    "assign_blocks",
    "block_pairs",
    "completed_keys",
    "chunk_within_key",
    "fold_status",
    "attribute_failures",
    "status_summary",
    "stage_matrix",
    "missing_artifacts",
    "compress_runs",
    "candidate_pairs",
    "stitch",
    "repeat_track",
    "quality_trim",
    "remove_gaps",
    "filter_overlaps",
    "overlap_stats",
    "overlap_graph",
    "tour",
    "path_sequences",
    "streamed_status",
    "streamed_screen",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "readloom-bench",
        f"local[{cpus}]",
        int(cpus),
        **{"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries["overlap_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
