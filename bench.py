"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from rankloom.plans.registry import QUERIES
from rankloom.runtime import local_session

HEADLINE = [
    "judgments_join_catalog",
    "balanced_sample_topup",
    "corpus_dedup",
    "bm25_topk",
    "tfidf_topk",
    "dense_topk",
    "encoded_dense_topk",
    "hybrid_topk",
    "weight_sweep",
    "pair_rerank",
    "ltr_features",
    "metrics_by_method",
    "win_loss_counts",
    "search_batch",
    "latency_stats",
]
WARM_UP = ["label_counts", "bm25_topk", "tfidf_topk", "dense_topk", "metrics_by_method"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, spark__rankloom__scanPartitions=cpus)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # compile the code paths on the smallest tables first
        for name in WARM_UP:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    n_queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "bm25_queries_per_sec": round(n_queries / seconds["bm25_topk"], 2),
                "hybrid_queries_per_sec": round(n_queries / seconds["hybrid_topk"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
