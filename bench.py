"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the input, BENCH_CPUS the local cores, BENCH_QUERIES an optional
comma-separated choice. Every result is computed in full and thrown away by the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cloneflow import build_session  # noqa: E402
from cloneflow.plans.catalog import CATALOG  # noqa: E402

HEADLINES = [
    "pair_generate",
    "vocab_count",
    "token_edges",
    "dummy_pad_nodes",
    "graph_node_jaccard",
    "token_overlap",
    "bag_quick_ratio",
    "graph_edit_similarity",
    "bow_cosine",
    "fuzzy_token_sort",
    "rolling_hash",
    "jaccard",
    "levenshtein",
    "metric_profile",
    "ngram_similarity",
    "rk_match",
    "winnow",
    "comment_similarity",
    "call_similarity",
    "longest_block",
    "tfidf_cosine",
    "minhash_candidates",
    "minhash_classes",
    "kgram_join",
    "cosine_similarity",
    "lookup_doc_vectors",
    "threshold_sweep",
    "legacy_sweep",
    "approach_leaderboard",
    "random_walk_graph",
    "pca_projection",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session(
        "cloneflow-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(CATALOG["jaccard"], spark, sf_dir)
    times = {n: run(CATALOG[n], spark, sf_dir) for n in names}
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
