"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line. Every query is executed in full
into Spark's no-op sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "all_metrics",
    "all_metrics_by_month",
    "mrr_by_month",
    "cohort_table",
    "cohort_grid",
    "forecast_scenarios",
    "scenario_projection",
    "snapshot_upsert",
    "mom_deltas",
    "report_summary",
    "sessions_idle",
    "sessions_max_age",
    "pii_scrub",
    "plan_from_sales",
    "cleaning_report",
]

# Queries that read tables which an earlier query of the list stored.
COLD = ["mrr_by_month", "cohort_table", "forecast_scenarios", "report_summary", "sessions_max_age"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from recurra.session import get_spark
    spark = get_spark(f"local[{cpus}]", max(cpus, 8), app_name="recurra-bench")
    from recurra.plans import catalog

    # Warm-up of the JVM (class loading, JIT, codegen) on the smallest input
    # folder, a different input, so nothing at the measured scale is
    # pre-built. The first headline query pays for building the materialized
    # rollup that later metric plans share.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for q in ("all_metrics", "sessions_idle"):
            catalog.QUERIES[q](spark, warm).write.format("noop").mode("overwrite").save()
    spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    # Each query again with what is stored (warm), and those that read stored tables once more without (cold).
    def timed(name: str) -> float:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - t0, 3)

    again = {name: timed(name) for name in names}
    cold = {}
    for name in [n for n in COLD if n in names]:
        catalog.forget()
        cold[name] = timed(name)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": total, "unit": "sec",
                      "queries": timings, "warm": again, "cold": cold, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
