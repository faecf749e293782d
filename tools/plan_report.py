"""Executed-plan summary for every registered query (after AQE): counts of
exchanges, joins, windows, generators and the scans' read schemas.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark(app="tessera-plans")
    queries, _ = load_all()
    print("# Executed plans (AQE final), " + sf.rsplit("/", 1)[-1] + "\n")
    print("Counts per registered query. `shuffle` = hash/range exchanges of the final query "
          "(written intermediates are separate jobs and not counted); `BHJ`/`SMJ` = broadcast / sort-merge "
          "joins; `input columns` = columns read from the driver tables.\n")
    print("| query | shuffle | BHJ | SMJ | window | generate | input columns |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in queries.items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        cols = sorted(set(m for m in re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*testdata", plan)))
        cols = "; ".join(re.sub(r"#\d+L?", "", c) for c in cols)
        print(f"| {name} | {ex} | {plan.count('BroadcastHashJoin')} | {plan.count('SortMergeJoin')} | "
              f"{len(re.findall(r'Window \[', plan))} | {plan.count('Generate ')} | {cols} |")


if __name__ == "__main__":
    main()
