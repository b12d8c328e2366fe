"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stridegrid.plans import catalog
from stridegrid.plans.session import local_session

HEADLINE = [
    "knee_and_pelvis_summary",
    "rolling_mean",
    "linear_gap_fill",
    "zero_phase_lowpass",
    "one_euro",
    "pairwise_overlap",
    "isolated_detections",
    "similarity_join",
    "merge_intervals",
    "interval_join",
    "track_summary",
    "derived_signals_checked",
    "series_quantiles",
    "resample_cycles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
