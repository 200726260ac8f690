"""Golden values of the search, index and service operators, computed by hand."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.functions.stats import exclusive_quantile
from vellumspark.functions.text import mean_length, richness
from vellumspark.operators import access, bloom, cache, features, harness, index, metrics, pattern, ring, search, store
from vellumspark.sources import storage, synth


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame([(1, "apple banana"), (2, "banana cherry"), (3, "apple cherry date"), (4, "Apple apple")], "doc_id long, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def scores(df):
    return [(r["doc_id"], r["score"]) for r in df.orderBy("query_id", "rank").collect()]


def test_micro_search(spark, micro):
    q = queries(spark, "apple BANANA apple")
    assert scores(search.search_idf(micro, q)) == [(1, 0.833333), (2, 0.5), (3, 0.333333), (4, 0.333333)]
    found = search.search_coordination(micro, q)
    assert scores(found) == [(1, 0.5), (2, 0.25), (3, 0.25), (4, 0.25)]
    assert {r["doc_id"]: r["match_positions"] for r in found.collect()} == {1: [1, 1], 2: [1], 3: [1], 4: [1]}
    assert scores(search.jaccard(micro, queries(spark, "apple banana"))) == [(1, 1.0), (4, 0.5), (2, 0.333333), (3, 0.25)]
    assert scores(search.jaccard(micro, queries(spark, "none"), k=2)) == [(1, 0.0), (2, 0.0)]


def test_unknown_and_empty_queries(spark, micro):
    q = queries(spark, "zzzzz", "", "apple")
    assert {r["query_id"] for r in search.search_idf(micro, q).collect()} == {2}
    assert [(r["query_id"], r["term"]) for r in search.unmatched_terms(micro, q).collect()] == [(0, "zzzzz")]


def test_posting_cap(spark):
    docs = spark.range(150).select(F.col("id").alias("doc_id"), F.lit("common").alias("text"))
    got = scores(search.search_idf(docs, queries(spark, "common"), k=1000))
    assert got == [(i, round(1 / 150, 6)) for i in range(100)]
    assert len(scores(search.search_idf(docs, queries(spark, "common"), k=1000, limit=None))) == 150


def test_latest_version(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, t string")
    assert sorted(map(tuple, index.latest_version(rows, "k", "v").collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_text_statistics(spark):
    df = spark.createDataFrame([(["aa", "bbbb", "aa"],), ([],)], "ts array<string>").select(mean_length(F.col("ts")), richness(F.col("ts")))
    assert [tuple(r) for r in df.collect()] == [(pytest.approx(8 / 3), pytest.approx(2 / 3)), (0.0, 0.0)]
    counts = spark.createDataFrame([(1, "aa", 2), (1, "bbbb", 1)], "key int, token string, n long")
    assert features.character_entropy(counts).first()["entropy"] == pytest.approx(1.0)


def test_bloom_sizes_and_no_false_negatives(spark):
    assert [(s.bits, s.hashes) for s in bloom.cascade_sizes(500_000)] == [(2396264, 3), (3117612, 4), (3838959, 5), (4560307, 6)]
    assert (bloom.size_for(1562, 0.01).bits, bloom.size_for(1562, 0.01).hashes) == (14971, 6)
    terms = spark.range(500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    size = bloom.size_for(500, 0.01, 1)
    absent = spark.range(2000).select(F.concat(F.lit("no"), F.col("id").cast("string")).alias("term"))
    words = bloom.build(terms, size)
    assert bloom.probe(terms, words, size).filter("not maybe").count() == 0
    assert bloom.probe(absent, words, size).filter("maybe").count() < 80
    assert bloom.cascade_probe(terms, terms, bloom.cascade_sizes(500)).filter("not maybe").count() == 0


def test_ring_against_bisect(spark):
    import bisect
    import hashlib

    nodes = sorted((r["pos"], r["shard_id"]) for r in ring.ring(spark, 5, 20).collect())
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("term"))
    got = {r["term"]: r["shard_id"] for r in ring.lookup(keys, ring.ring(spark, 5, 20)).collect()}
    h = lambda s: int(hashlib.md5(f"0:{s}".encode()).hexdigest()[:8], 16)
    assert got == {f"k{i}": nodes[bisect.bisect_left(nodes, (h(f"k{i}"), -1)) % len(nodes)][1] for i in range(2000)}


def test_decay(spark):
    log = spark.createDataFrame([("k", "2024-01-01 00:01:00"), ("k", "2024-01-01 00:00:50"), ("k", "2024-01-01 00:00:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-01 00:01:00")
    assert access.decayed(log, "key", now, 0.1, horizon=50).first()["weight"] == pytest.approx(1 + math.exp(-1), abs=1e-6)
    assert access.decayed(log, "key", now, 0.1).first()["weight"] == pytest.approx(1 + math.exp(-1) + math.exp(-6), abs=1e-6)


def test_quantiles_as_the_standard_library(spark):
    for n in (1, 2, 3, 19, 20, 100, 250):
        xs = [((i * 7919) % 1009) / 10 for i in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "v double")
        got = df.agg(F.sort_array(F.collect_list("v")).alias("xs")).select(exclusive_quantile(F.col("xs"), 19, 20).alias("q")).first()["q"]
        want = statistics.quantiles(xs, n=20)[18] if n > 1 else xs[0]
        assert got == pytest.approx(want)
        if n > 1:
            assert metrics.ranked_quantiles(df, "v").first()["p95"] == pytest.approx(want, abs=1e-6)


def test_pruning():
    def row(c2, c3, access_count):
        differing = [np.zeros((1, 1)), np.zeros((1, 1)), np.array([[float(c2.bit_count())]]), np.array([[float(c3.bit_count())]])]
        return bool(pattern.explores(differing, np.array([float(access_count)]))[0, 0])

    assert row((1 << 16) - 1, 15, 0) and not row((1 << 17) - 1, 15, 0)
    assert row((1 << 17) - 1, 15, 100)


def test_more_queries_than_a_block(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float((i * 37 + j * 11) % 17 - 8) for j in range(4)]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = [(i, [0.5 + i % 3, 1.0, float(i % 7)], {f"t{i % 5}": 1.0, "all": 2.0}, f"form {i % 9}") for i in range(40)]
    docs = spark.createDataFrame(rows, "key long, stats array<double>, weights map<string, double>, canonical string").withColumn("norm", F.lit(1.0))
    sigs = pattern.signatures(docs)

    def run():
        found = [pattern.vector_search(vectors, asked, k=3), pattern.cosine_search(docs, docs, k=3), pattern.signature_search(sigs, sigs, k=3), pattern.pattern_search(docs, docs, k=3, min_similarity=0.0)]
        return [sorted(map(tuple, df.collect())) for df in found]

    whole = run()
    assert [len({r[0] for r in rows}) for rows in whole] == [60, 40, 40, 40]
    monkeypatch.setattr(pattern, "MAX_QUERIES", 7)
    assert run() == whole
    plan = pattern.vector_search(vectors, asked)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Against all pairs.
    vs = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for q, v, s, r in whole[0]:
        best = sorted(((-round(cos(vs[q], vs[o]), 6), o) for o in vs))[r - 1]
        assert (v, s) == (best[1], pytest.approx(-best[0], abs=2e-6))


def test_cache(spark):
    now = [0.0]
    c = cache.ResultCache(capacity=2, ttl=300, clock=lambda: now[0])
    a, b, d = (spark.range(k) for k in (1, 2, 3))
    c.put("Q", 10, a)
    assert c.get("q", 10) is not None and c.get("q", 20) is None and c.get("q", 10, version=1) is None
    c.put("r", 10, b)
    c.put("q", 10, a)  # put again: no other entry goes
    assert c.get("r", 10) is not None
    c.put("s", 10, d)  # the oldest put goes
    assert c.get("r", 10) is None and c.get("q", 10) is not None
    now[0] = 300.0
    assert c.get("s", 10) is not None
    now[0] = 300.1
    assert c.get("s", 10) is None


def test_stored_index(spark, micro, tmp_path):
    path = str(tmp_path / "index")
    built = store.build_index(micro, path, false_positives=0.01, shards=4)
    q = queries(spark, "apple BANANA apple", "zzzzz", "", "cherry")
    for limit in (100, None, 1):
        assert scores(search.search_idf(built, q, limit=limit)) == scores(search.search_idf(micro, q, limit=limit))
    assert scores(search.search_idf(built, q, prefilter=True)) == scores(search.search_idf(micro, q))
    assert scores(search.search_coordination(built, q)) == scores(search.search_coordination(micro, q))
    assert sorted(map(tuple, search.unmatched_terms(built, q).collect())) == [(1, "zzzzz")]
    one = [(r["doc_id"], r["score"], r["rank"]) for r in built.search("apple BANANA apple").orderBy("rank").collect()]
    assert one == [(1, 0.833333, 1), (2, 0.5, 2), (3, 0.333333, 3), (4, 0.333333, 4)] and built.search("zzzzz").count() == 0
    hits = {(r["term"], r["doc_id"]): r["hits"] for r in search.posting_hits(built, q).collect()}
    assert hits == {("apple", 1): 1, ("apple", 3): 1, ("apple", 4): 1, ("banana", 1): 1, ("banana", 2): 1, ("cherry", 2): 1, ("cherry", 3): 1}
    assert "shard_id" in built.lists_of("apple")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    # A new version; results of the old one do not answer for it.
    kept = cache.ResultCache()
    assert kept.capacity == 10_000 and built.search("fig", cache=kept).count() == 0
    store.build_index(micro.unionAll(spark.createDataFrame([(5, "fig")], micro.schema)), path, version=2, shards=4)
    newest = store.open_index(spark, path)
    assert newest.version == 2 and newest.meta["documents"] == 5 and newest.search("fig", cache=kept).count() == 1
    assert built.search("fig", cache=kept).count() == 0 and len(kept.entries) == 2
    empty = store.build_index(micro.limit(0), str(tmp_path / "empty"))
    assert search.search_idf(empty, q).count() == 0
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        store.open_index(spark, str(tmp_path / "none"))


def test_storage_scopes(spark):
    with storage.Scope() as outer:
        a = storage.materialize(spark.range(3))
        with storage.Scope() as inner:
            b = storage.materialize(spark.range(4))
        inner.discard()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(b._vellum_path)
    outer.discard(a)
    assert a.count() == 3


def test_harness(spark, micro, tmp_path):
    built = store.build_index(micro, str(tmp_path / "index"))
    asked = ["apple", "banana cherry", "zzzzz"]
    timings = harness.run(spark, built.search, asked, iterations=2, threads=2, batch=2)
    assert sorted((r["batch"], r["query"], r["iteration"], r["rows"]) for r in timings.collect()) == sorted((k // 2, q, i, n) for k, (q, n) in enumerate(zip(asked, (3, 3, 0), strict=True)) for i in range(2))
    report = harness.report(timings).collect()[0]
    assert report["runs"] == 6 and report["min_time"] <= report["avg_time"] <= report["max_time"] <= report["p99"] + 1
    assert {r["batch"] for r in harness.batches(timings).collect()} == {0, 1}
    assert {r["query"] for r in harness.compare(spark, built.search, built.search, asked[:1]).collect()} == {"apple"}
    assert harness.run(spark, built.search, []).count() == 0


def test_retrieval_word_order_and_concurrency(spark):
    from concurrent.futures import ThreadPoolExecutor

    data = [("test_1", "test document content"), ("pattern_1", "apple banana cherry"), ("pattern_2", "cherry banana apple")] + [(f"concurrent_{i}", f"test document {i}") for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    vocabulary = features.fit_vocabulary(docs)
    stored = features.patterns(docs, vocabulary, "doc_id")

    def ask(text):
        q = features.patterns(queries(spark, text), vocabulary, "query_id", "query")
        return {r["doc_id"]: r["score"] for r in pattern.cosine_search(stored, q).collect()}, {r["doc_id"]: r["score"] for r in pattern.pattern_search(stored, q).collect()}

    assert "test_1" in ask("test document content")[0]
    # Word order changes neither search; a shared word counts in the cosine.
    assert ask("apple banana") == ask("banana apple") and {"pattern_1", "pattern_2"} <= set(ask("apple banana")[0])
    with ThreadPoolExecutor(4) as pool:
        assert all("concurrent_3" in found[0] for found in pool.map(ask, ["test document 3"] * 4))


def test_zipf_values(spark):
    rows = synth.zipf_documents(spark, 200, size=1000).collect()
    assert rows == synth.zipf_documents(spark, 200, size=1000).collect()
    words = {r["word"]: r["rank"] for r in synth.vocabulary(spark, 1000).collect()}
    ranks = [words[w] for r in rows for w in r["terms"]]
    assert all(r["terms"] == sorted(set(r["terms"])) and r["content"] == " ".join(r["terms"]) for r in rows)
    assert sum(k == 1 for k in ranks) == 200 and sum(k <= 10 for k in ranks) > sum(100 < k <= 110 for k in ranks) * 5
    asked = [r["query"].split() for r in synth.zipf_queries(spark, 3000, size=1000).collect()]
    first = sum(words[w] == 1 for q in asked for w in q) / 9000
    # The continuous law's mass of rank 1: (1 - 2 ** -0.5) / (1 - 1001 ** -0.5).
    assert all(len(q) == 3 for q in asked) and abs(first - (1 - 2**-0.5) / (1 - 1001**-0.5)) < 0.03
