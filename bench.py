"""Benchmark: headline queries at one scale factor, one JSON line out.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8).  Each query is executed completely with the ``noop`` sink (no
collect, no driver transfer).  Times are steady-state: before timing, every
headline query runs once, untimed, on the smallest test tables (sf0.001) so
that JVM code paths are compiled; the timed run then reads the target scale.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attrix.plans.catalog import load_all  # noqa: E402
from attrix.session import get_spark  # noqa: E402

HEADLINE = [
    "agg_10_segment_two_keys",      # flagship: plan x inquiries summary
    "prj_model_ready",              # whole preparation step
    "prj_align_schema",             # incoming aligned to the training schema
    "agg_9_segment_summary",
    "agg_16_crosstab_lineitem",
    "agg_17_describe_lineitem",     # exact medians, distributed
    "agg_21_outliers_lineitem",     # exact quartiles per column
    "agg_22_boxplot_lineitem",
    "agg_23_histogram_lineitem",
    "agg_19_missing_values",
    "agg_29_default_profile",
    "spl_1_stratified_split",       # exact stratified split
    "spl_3_stratified_folds",
    "ml_compare",                   # metrics + tie-aware AUC per model
    "ml_roc",
    "srt_1_top_risk",
    "flt_9_outside_range",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("attrix-bench", cpus=cpus)
    registry = load_all()
    # warm-up on the smallest tables (JIT) — not timed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            registry[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        fn = registry[name][0]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
