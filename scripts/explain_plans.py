"""Summarise the executed (AQE final) plans of the headline queries:
shuffles, broadcasts, join kinds, codegen stages, scans with their pruned
read schema and pushed filters.  Writes a markdown table to stdout.

usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from linkgraph.plans.queries import QUERIES  # noqa: E402
from linkgraph.session import local_session  # noqa: E402


def summarise(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    pushed = [p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p]
    return {
        "shuffles": count(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|"
                          r"Exchange RoundRobin"),
        "reused": count(r"ReusedExchange"),
        "broadcasts": count(r"BroadcastExchange"),
        "smj": count(r"SortMergeJoin"),
        "bhj": count(r"BroadcastHashJoin"),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", plan))),
        "window_group_limit": count(r"WindowGroupLimit"),
        "scans": len(scans),
        "widest_scan": max((s.count(":") for s in scans), default=0),
        "pushed": len(pushed),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(shuffle_partitions=16)
    cols = None
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        ex = df._jdf.queryExecution().executedPlan()
        ex.execute().count()  # runs this plan, so AQE's final plan is shown
        plan = ex.toString().split("== Initial Plan ==")[0]
        s = summarise(plan)
        if cols is None:
            cols = list(s)
            print("| query | " + " | ".join(cols) + " |")
            print("| --- " * (len(cols) + 1) + "|")
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
