"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["knn_l2_topk", "knn_cosine_topk", "knn_join_labels", "vector_norms", "chunk_windows", "chunk_packed", "tokenize_counts", "hashed_embed_md5", "hashed_embed_blake2b", "retrieve_lexical_md5", "delete_rebuild_dense_ids", "corpus_stats", "recall_ivf", "recall_hnsw", "windowed_event_counts"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from vecspark.operators.ann import GraphIndex
    from vecspark.operators.knn import knn, recall
    from vecspark.plans.queries import QUERIES
    from vecspark.sources.storage import scratch, written
    from vecspark.sources.text_files import generated_vectors

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(QUERIES["knn_cosine_topk"](spark, SF_DIR))  # warm-up
    took = {}
    for name in HEADLINE:
        start = time.time()
        sink(QUERIES[name](spark, SF_DIR))
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    # The published experiment's shape: 50,000 x 128 vectors in 1,000 clusters, 200 queries, exact.
    v = written(generated_vectors(spark, 50_000, 128, clusters=1000), "bench-vectors")
    asked = v.where("vec_id % 250 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    start = time.time()
    sink(knn(v, asked, 10, "l2"))
    took["exact_50k_128_200q"] = round(time.time() - start, 3)
    start = time.time()
    index = GraphIndex(spark, scratch(spark, "bench-graphs"), 128, "l2").add(v)
    took["graph_build_50k_128"] = round(time.time() - start, 3)
    start = time.time()
    sink(index.search(asked, 10, 100))
    took["graph_search_50k_128_200q"] = round(time.time() - start, 3)
    start = time.time()
    sink(index.search(asked, 10, 100, walk=True))
    took["graph_walk_50k_128_200q"] = round(time.time() - start, 3)
    reached = recall(knn(v, asked, 10, "l2"), index.search(asked, 10, 100), 10).first()[0]
    many = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    start = time.time()
    sink(index.search(many, 10, 100))
    took["graph_search_50k_128_10000q"] = round(time.time() - start, 3)
    start = time.time()
    sink(knn(v, many, 10, "l2"))
    took["exact_50k_128_10000q"] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "exact_us_per_query": round(took["exact_50k_128_200q"] / 200 * 1e6), "exact_us_per_query_of_10000": round(took["exact_50k_128_10000q"] / 10_000 * 1e6), "graph_us_per_query_of_10000": round(took["graph_search_50k_128_10000q"] / 10_000 * 1e6), "graph_recall_at_10": round(reached, 4), "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
