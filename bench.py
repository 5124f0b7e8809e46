"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed (result collected; results are small).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tfidf_evaluate",          # flagship: fit + exact ranks + metrics
    "mine_hard_negatives_sparse",
    "dense_evaluate",
    "low_resource_splits",
    "parse_responses",
    "triplets_from_negatives",
    "contrastive_triplets",
    "split_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pairlane.session import local_session
    from pairlane.plans.registry import all_queries

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    qs = all_queries()
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q in qs]
    # JVM warm-up (class loading, JIT, codegen of the operator shapes): one
    # untimed run of the flagship on the sf0.01 tables (large enough to take
    # the blocked scoring path, like the timed runs).  Different input,
    # so nothing computed here is reused by the timed runs.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        qs["tfidf_evaluate"](spark, warm_dir).collect()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for q in names:
        t0 = time.time()
        df = qs[q](spark, sf_dir)
        n = 0
        for _ in df.toLocalIterator():
            n += 1
        times[q] = round(time.time() - t0, 3)
        print(f"# {q}: {times[q]}s rows={n}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
