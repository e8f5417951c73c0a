"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query to completion (a ``noop`` sink forces every row and
column to be computed, unlike ``count()`` which lets Catalyst prune), three
times, and reports the median.  Prints ONE JSON line:
{"metric", "value", "unit", "queries": {name: sec}, "sf", "runs"}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sparse_topk",          # E4  BM25 top-k, inverted-index join
    "dense_topk",           # E8  exact cosine top-k, block matmul
    "hybrid_topk",          # E11 dense + sparse fusion
    "overlap_prf",          # D4  result-set comparison for all questions
    "ordered_match",        # D5  ordered comparison via distributed ordinal
    "component_match",      # C19 clause matching over the query log
    "score_overall",        # C24 rule scores over the query log
    "pipeline_summary",     # F1  per DB x pipeline summary
    "combined_totals",      # F6  grouping sets
    "join_group",           # B28 lineitem x part aggregate
    "multi_join_hard",      # B48 4-way join + aggregate
    "stage_timings",        # F17 predecessor join over events
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.registry import all_queries
    from quarry.session import build_session

    scratch = tempfile.mkdtemp(prefix="quarry-bench-")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          app_name="quarry-bench",
                          extra={"spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    qs = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # warm-up on the smallest fixture: JVM class loading, JIT and Python worker
    # start are not the queries' cost
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        qs["sparse_topk"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    qs["agg_count_star"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for n in names:
        took = []
        for _ in range(runs):
            t0 = time.time()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        times[n] = round(statistics.median(took), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "runs": runs}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
