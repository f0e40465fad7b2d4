"""Bench: wall time of the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS], forcing full execution with the `noop` sink (no
collect to the driver).  One warm-up pass, then the median of
$BENCH_REPEATS timed runs per query.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkgraph.plans.queries import QUERIES  # noqa: E402
from linkgraph.session import local_session  # noqa: E402

HEADLINE = ["common_friends", "mask_pair_hist", "twohop_stats", "feature_table",
            "topk_recommend", "auc", "ndcg", "mask_pca", "run_report"]


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * cpus), app="linkgraph-bench")
    run(spark, names[0], sf_dir)  # JVM / codegen warm-up
    times = {}
    for n in names:
        ts = [run(spark, n, sf_dir) for _ in range(repeats)]
        times[n] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
