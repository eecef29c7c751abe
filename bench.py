"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up the JVM's code (on the same tables), then BENCH_REPEATS times; the median
counts. Results go to the noop sink, so all rows and columns are worked out.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "neighbors_binned", "neighbors_dense", "rdf", "coordination_pmf", "bond_angle_histogram", "local_structure", "coverage_join",
    "msd_by_lag", "msd_fft", "vacf_by_lag", "van_hove", "current_correlation", "vacf_spectrum", "welch_spectrum",
    "state_residence", "state_transitions", "event_bursts", "window_attach", "autocorrelation_time", "block_plan", "event_asof",
    "cic_density", "kernel_density", "scalar_summary", "metrics_by_condition", "reference_fit", "text_fingerprint", "duplicate_groups",
    "leakage_findings", "balanced_sample", "purged_kfold", "greedy_coverage", "session_bursts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from framelake.registry import QUERIES
    from framelake.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(1 + repeats):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
