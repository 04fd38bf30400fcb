"""Benchmark the headline queries.

Runs each query of BENCH_QUERIES at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]: one warm-up, then the median of $BENCH_REPS runs. A run
executes the whole plan into the ``noop`` sink (nothing is collected). Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import get_spark  # noqa: E402
from tessera.suite import registry  # noqa: E402

BENCH_QUERIES = {
    "D2": "D2_pack_chunks",
    "D7": "D7_search",
    "D9": "D9_docu_search",
    "F3": "F3_sliding_memory",
    "G2": "G2_run_chain",
    "G2M": "G2_chain_with_memory",
    "H1": "H1_main_text",
    "H3": "H3_search_pages",
    "L1": "L1_stream_documents",
    "T5": "T5_group_aggregate",
    "T12": "T12_merge_inner",
}


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_spark()
    qs = registry.all_queries()
    times, failed = {}, []
    for short, name in BENCH_QUERIES.items():
        fn = qs[name][0]
        try:
            run_once(spark, fn, sf_dir)  # warm-up
            times[short] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(reps)), 3)
        except Exception as e:  # noqa: BLE001 - report the failure, keep measuring the others
            print(f"{short} failed: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            failed.append(short)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "headline_total_median", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
