"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["document_frequency", "postings_capped", "search_idf", "search_idf_batch", "search_coord_batch", "jaccard_topk", "text_stats", "tfidf_vectors", "pattern_cosine", "search_pattern", "embedding_topk", "bloom_probe", "ring_lookup", "latency_quantiles", "metrics_tumbling_1d"]
REPEAT_QUERIES = 10_000
#: Queries that are asked one at a time for the latency figures.
SINGLE = 40


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from vellumspark.operators import harness, search, store
    from vellumspark.plans import indexes, registry
    from vellumspark.sources import storage, synth

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(registry.queries()["search_idf"](spark, sf_dir))  # starts and warms the JVM
    times = {}
    # What the searches read is written once, and timed as such; the warm-up's tables are left behind.
    indexes.forget()
    for name, build in (("build_index", indexes.stored_index), ("build_patterns", indexes.stored_patterns)):
        began = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr)
    for name in HEADLINE:
        began = time.perf_counter()
        noop(registry.queries()[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr)
    # The published run: 50,000 documents of 100 random words, 10,000 queries of 3, all in one job. Building includes writing.
    docs = synth.uniform_documents(spark, 50_000).select("doc_id", F.col("content").alias("text")).cache()
    docs.count()
    began = time.perf_counter()
    index = store.build_index(docs, storage.new_path(spark, "bench"), false_positives=0.01)
    build = time.perf_counter() - began
    asked = synth.uniform_queries(spark, REPEAT_QUERIES)
    began = time.perf_counter()
    noop(search.search_idf(index, asked))
    batch = time.perf_counter() - began
    single = [r["query"] for r in asked.limit(SINGLE).collect()]
    latency = harness.report(harness.run(spark, index.search, single, threads=4)).first()
    times |= {"published_index_build": round(build, 3), "published_query_batch": round(batch, 3)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2], "index_docs_per_s": round(50_000 / build, 1), "batch_queries_per_s": round(REPEAT_QUERIES / batch, 1), "single_query_s": {k: latency[k] for k in ("avg_time", "p95", "p99")}}))


if __name__ == "__main__":
    main()
