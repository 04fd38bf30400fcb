"""Summarise the executed physical plans of the headline queries into PLANS.md.

Usage: python tools/show_plans.py [sf_dir]

Each query runs once (so AQE's final plan is known); the summary counts
shuffles, join strategies, window group limits, codegen stages and scans, and
lists each scan's pushed filters and read schema.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import BENCH_QUERIES  # noqa: E402
from tessera.session import get_spark  # noqa: E402
from tessera.suite import registry  # noqa: E402

MARKERS = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
           "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit", "Window", "HashAggregate",
           "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject", "MapInPandas", "FlatMapCoGroupsInPandas",
           "ArrowEvalPython", "Generate"]


def summarise(spark, name, fn, sf_dir):
    df = fn(spark, sf_dir)
    df.collect()  # runs this DataFrame's own plan, so AQE's final plan is the one read below
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    counts = {m: len(re.findall(rf"\b{m}\b", plan)) for m in MARKERS}
    counts["Shuffle"] = len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|"
                                       r"RoundRobinPartitioning)", plan))
    counts["WholeStageCodegen"] = len(re.findall(r"\*\(\d+\)", plan))
    scans = []
    for line in plan.splitlines():
        if "FileScan" in line:
            table = re.search(r"testdata/[^/]+/(\w+)\.parquet|tessera/([a-z-]+[a-z])", line)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            schema = re.search(r"ReadSchema: (\S+)", line)
            if table and table.group(1):
                name = table.group(1)
            elif table:
                name = {"vec": "vector index", "pag": "page index"}.get(table.group(2)[:3], table.group(2))
            else:
                name = "?"
            scans.append((name,
                          pushed.group(1) if pushed else "", schema.group(1) if schema else ""))
    return counts, scans


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    qs = registry.all_queries()
    out = ["# Executed plans of the headline queries", "",
           f"Generated by `tools/show_plans.py {sf_dir}` (final AQE plans after one run).", "",
           "| query | shuffles | broadcast joins | sort-merge joins | nested-loop / cartesian | window group limits | "
           "codegen stages | pandas stages |", "|---|---|---|---|---|---|---|---|"]
    details = []
    for short, name in BENCH_QUERIES.items():
        c, scans = summarise(spark, name, qs[name][0], sf_dir)
        pandas = c["MapInPandas"] + c["FlatMapCoGroupsInPandas"] + c["ArrowEvalPython"]
        out.append(f"| {short} ({name}) | {c['Shuffle']} | {c['BroadcastHashJoin']} | "
                   f"{c['SortMergeJoin']} | {c['BroadcastNestedLoopJoin'] + c['CartesianProduct']} | "
                   f"{c['WindowGroupLimit']} | {c['WholeStageCodegen']} | {pandas} |")
        for t, pushed, schema in scans:
            details.append(f"| {short} | {t} | {pushed or '-'} | `{schema}` |")
    out += ["", "Scans (pushed filters and pruned read schema):", "", "| query | table | pushed filters | read schema |",
            "|---|---|---|---|"] + details
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
