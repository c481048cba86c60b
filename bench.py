"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from outlay.catalog import all_queries
from outlay.session import local_session

# Self-measured baseline set first, then one heavy query of every other family.
HEADLINE = [
    "B1_cost_by_service",
    "B5_credits_breakdown",
    "B8b_backfill_anomalies",
    "K1_usage_from_samples",
    "D4_commitment_size",
    "B2_cost_by_label",
    "B4_commitment_coverage",
    "B6_unattached_disk_cost",
    "B7_egress_cost",
    "I8_all_findings",
    "K3_vpa_comparison",
    "Q1_query_rollup",
    "Q5_table_layout",
    "G3_bucket_plans",
    "R2_capacity_plan",
    "T_rate",
    "A1_instance_cpu",
]
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries, timings, split = all_queries(), {}, {}
    for name in HEADLINE:
        runs = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            df = queries[name](spark, sf_dir)
            built = time.perf_counter()
            df._jdf.queryExecution().executedPlan()
            planned = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            if i:  # the first run warms up
                runs.append((built - start, planned - built, time.perf_counter() - planned))
        parts = [round(statistics.median(x), 3) for x in zip(*runs)]
        split[name] = dict(zip(("build", "plan", "run"), parts))
        timings[name] = round(sum(parts), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "parts": split,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "runs": RUNS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
