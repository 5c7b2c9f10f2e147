"""Time the headline queries and print one JSON line.

Each query runs once to warm up and once for the clock; its result is written to the no-op sink, so
every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.session import build_session  # noqa: E402
from tracewell.workload import QUERIES  # noqa: E402

HEADLINE = (
    "directly_follows",
    "directly_follows_clicks",
    "traces",
    "case_analysis",
    "prefixes_inclusive",
    "prefixes_next",
    "next_activity_sequences",
    "bucket_sequences",
    "prefix_features",
    "compact_features",
    "smart_clean",
    "duplicates_keep_first",
    "outliers_per_group",
    "anonymise_numeric",
    "profile_numeric",
    "profile_categorical",
    "profile_datetime",
    "process_metrics",
    "footprint",
    "alpha_places",
    "heuristics_arcs",
    "score_cases",
    "bucket_scores",
    "decision_tree_outcomes",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tracewell-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    seconds = {}
    for name in names:
        for attempt in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
