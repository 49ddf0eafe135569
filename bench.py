"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then ``$BENCH_RUNS`` times with a sink
that materialises every row; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadstats.plans.queries import QUERIES  # noqa: E402
from roadstats.session import local_session  # noqa: E402

HEADLINE = {
    "q1": "group_count",
    "q2": "nested_types",
    "q3": "nested_times",
    "q4": "nested_conditions",
    "q5": "nested_pedestrian",
    "q6": "nested_drivers",
    "q7": "nested_makes",
    "q8": "scenario_rules",
    "q9": "driver_rules",
    "repair": "json_repair",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for key, name in HEADLINE.items():
        run(name)
        seconds[key] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
