"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once unmeasured and then three times; the median is reported, planning, reading and
collecting the rows included. `cpu_loop` is the time of a fixed loop on one core, to tell slow machines from slow queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tessera.plans.catalog import REGISTRY
from tessera.session import session

HEADLINE = [
    "agg_pricing_summary",
    "join_six_tables",
    "sort_top_k_per_group",
    "join_anti",
    "agg_cube",
    "batch_tumbling",
    "join_asof",
    "join_range",
    "win_rows_frame",
    "agg_count_distinct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", cores=cores, spark__sql__shuffle__partitions=cores)
    times: dict[str, float] = {}
    began = time.perf_counter()
    sum(range(20_000_000))
    loop = round(time.perf_counter() - began, 4)
    for name in HEADLINE:
        REGISTRY.queries[name](spark, sf_dir).collect()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            REGISTRY.queries[name](spark, sf_dir).collect()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf, "cpu_loop": loop}))
    spark.stop()


if __name__ == "__main__":
    main()
