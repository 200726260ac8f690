"""Steps that once grew faster than their input, or that one task did alone; values against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumspark.functions import split, text
from vellumspark.functions.hashing import seeded_hash, signature_words
from vellumspark.operators import blocks, bloom, features, index, pattern, search, store
from vellumspark.plans import features_plans, index_plans, indexes, registry, search_plans
from vellumspark.sources import tables

SF = "/root/testdata/sf0.001"
TEXTS = ["apple Banana apple", "", None, "the of", "naïve 😀😀 été, été", "x" * 5000 + " y_1 😀"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture
def fresh():
    indexes.forget()
    yield
    indexes.forget()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def expected(spark, docs):
    counts = {}
    for r in features.token_counts(docs, "doc_id").collect():
        counts.setdefault(r["key"], {})[r["token"]] = r["n"]
    return counts


def test_f6_entropy_makes_no_row_of_a_character(spark, docs):
    df = features.text_entropy(docs, "doc_id")
    assert "Generate" not in plan(df) and plan(features_plans.char_entropy(spark, SF)).count("HashAggregate") == 0
    want = {}
    for key, tokens in expected(spark, docs).items():
        chars = Counter()
        for t, n in tokens.items():
            for ch in t:
                chars[ch] += n
        total = sum(chars.values())
        want[key] = -sum(c / total * math.log2(c / total) for c in chars.values())
    assert {r["key"]: r["entropy"] for r in df.collect()} == pytest.approx(want, abs=1e-9) and set(want) == {0, 4, 5}


def test_f1_shards_need_no_vocabulary(spark, docs, fresh):
    want = {k: hashlib.md5(" ".join(sorted((f"{t}:{n}" for t, n in c.items()), key=str.encode)).encode()).hexdigest() for k, c in expected(spark, docs).items()}
    assert {r["key"]: r["canonical"] for r in features.canonical_forms(docs, "doc_id").collect()} == want
    words = spark.createDataFrame([("a",)], "t string").select(*signature_words(F.col("t")), *[seeded_hash(i, F.col("t")) for i in range(100)]).first()
    bits = "".join("1" if h >= 2**31 else "0" for h in words[4:])
    assert [int(bits[i : i + 32], 2) for i in range(0, 100, 32)] == list(words[:4])
    features_plans.shard_assign(spark, SF)
    assert not indexes._patterns and indexes._signatures


def test_f7_walks_need_no_vocabulary(spark, fresh):
    features_plans.trie_prune(spark, SF)
    assert not indexes._patterns and indexes._signatures


def test_f2_patterns_are_made_without_a_shuffle(spark, docs):
    vocabulary = features.fit_vocabulary(docs)
    assert {r["term"]: (r["tf"], r["df"]) for r in vocabulary.collect()}["été"] == (2, 1)
    df = features.patterns(docs, vocabulary, "doc_id")
    assert "Exchange" not in plan(df)
    weights = {r["key"]: r["weights"] for r in df.collect()}
    want = {r["key"]: {} for r in df.collect()}
    for r in features.tfidf(features.token_counts(docs, "doc_id"), vocabulary).collect():
        want[r["key"]][r["term"]] = pytest.approx(r["w"])
    assert weights == want


def test_f5_found_texts_are_not_shuffled(spark):
    text = plan(features_plans.search_pattern(spark, SF))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_ties_at_the_end_of_a_batch(spark):
    for kind in ("long", "string"):
        docs = spark.range(500).select(F.col("id").cast(kind).alias("key"), *[F.lit(0).cast("bigint").alias(f"c{i}") for i in range(4)])
        found = pattern.signature_search(docs, docs.limit(2), k=3)
        assert {r["doc_id"] for r in found.collect()} == ({0, 1, 2} if kind == "long" else {"0", "1", "10"})


def test_f3_posting_hits_build_no_index(spark, fresh):
    search_plans.posting_hits(spark, SF)
    assert not indexes._built


def test_f4_cascade_builds_all_levels_in_one_pass(spark):
    terms, absent = (spark.range(400).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("term")) for p in ("t", "no"))
    sizes = bloom.cascade_sizes(400)
    want = None
    for size in sizes:
        passed = {r["term"] for r in bloom.probe(absent, bloom.build(terms, size), size).filter("maybe").collect()}
        want = passed if want is None else want & passed
    df = bloom.cascade_probe(absent.unionAll(terms), terms, sizes)
    assert "Range (0, 400" not in plan(df).split("Union")[0] and {r["term"] for r in df.filter("maybe").collect()} == want | {f"t{i}" for i in range(400)}
    assert df.count() == 800


def test_f9_f10_terms_need_no_index(spark, fresh):
    index_plans.bloom_bits(spark, SF)
    index_plans.ring_lookup(spark, SF)
    assert not indexes._built and indexes._terms


def test_f8_no_task_takes_a_shard(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "doc_id long, term string")
    assert "Exchange" not in plan(index.with_shard(pairs, 4))
    text = plan(index_plans.postings_sharded(spark, SF))
    assert "REPARTITION_BY" not in text.split("shard_id")[0] and "hashpartitioning(term" in text


def test_f11_uncapped_search_shuffles_no_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(w for w, m in (("a", 1), ("b", 2), ("c", 3), ("d", 50)) if i % m == 0)) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b c"), (1, "d d zz"), (2, ""), (3, "c")], "query_id long, query string")
    stored = search.search_idf(store.build_index(docs, str(tmp_path / "i")), asked, k=7, limit=None)
    df = search.search_idf(docs, asked, k=7, limit=None)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, stored.collect())) and "Generate" not in plan(df)


def test_f12_jaccard_makes_no_row_of_a_pair(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "b c"), (2, ""), (3, "a")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a a b"), (1, "zz")], "query_id long, query string")
    df = search.jaccard(docs, asked, k=3)
    assert "Generate" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(0, 0, 1.0, 1), (0, 1, 0.333333, 3), (0, 3, 0.5, 2), (1, 0, 0.0, 1), (1, 1, 0.0, 2), (1, 2, 0.0, 3)]


def test_shared_words():
    met = blocks.shared(pa.array([["a", "b"], [], ["b"]]), lambda terms: pa.array([{"a": 2.0, "b": 0.5}[t] for t in terms.to_pylist()]).to_numpy())
    counts, sums = met(pa.array([["b", "x", "a"], [], ["b"]]))
    assert counts.tolist() == [[2, 0, 1], [0, 0, 0], [1, 0, 1]] and sums.tolist() == [[2.5, 0, 0.5], [0, 0, 0], [0.5, 0, 0.5]]


def test_stored_terms_agree_with_the_index(spark, fresh):
    alone = sorted(map(tuple, registry.queries()["bloom_size"](spark, SF).collect()))
    indexes.stored_index(spark, SF)
    assert sorted(map(tuple, registry.queries()["bloom_size"](spark, SF).collect())) == alone


ODD = ["", None, "  \t\x0b\x0c\r\n", "a\x1cb c d e", "Straße ΣΑΣ İx", "é ́a _x_9", "漢字かな１２ ٣ x²", "😀a😀𝒳𝟘 \U0001e900", "'t don't the THE I'm", "a,b;;c--d‍.", "x" * 300 + "\u0085y", "\x00\x01 \x7f ¡", "the of", "tail 😀", "é"]


def test_words_of_batches_are_those_of_the_expressions(spark, monkeypatch):
    points = np.unpackbits(split.word_points(spark)).view(bool)
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "k long, t string")
    want = rows.orderBy("k").select(text.tokens(F.col("t")).alias("tokens"), text.terms(F.col("t")).alias("terms"), split.lowered(F.col("t")).alias("low")).toArrow().combine_chunks()
    low = want.column("low").combine_chunks()
    for texts, lists in ((low, want.slice(0)), (low.slice(5), want.slice(5)), (low.slice(3, 0), want.slice(3, 0))):
        for name, known in (("tokens", points), ("terms", None)):
            words = split.split(texts, known)
            got = [[] for _ in range(len(texts))]
            for r, w in zip(words.row, words.known.take(pa.array(words.code)).to_pylist(), strict=True):
                got[r].append(w)
            assert got == lists.column(name).to_pylist()
    monkeypatch.setattr(split, "SLICE_BYTES", 20)
    batch = pa.record_batch({"t": low})
    assert pa.Table.from_batches(split.slices(iter([batch, batch.slice(0, 0)]), 0)).column("t").to_pylist() == low.to_pylist()


def test_every_code_point_is_classed_as_the_jvm_does(spark):
    points = np.unpackbits(split.word_points(spark)).view(bool)
    every = spark.range(0x110000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("ch"))
    words = {r["id"] for r in every.filter(F.col("ch").rlike(r"[\p{L}\p{N}_]")).collect()}
    assert words == set(np.flatnonzero(points).tolist())


def test_f7_signatures_of_a_batch_are_those_of_the_expressions(spark, docs):
    made = features.canonical_forms(docs, "doc_id").collect()
    want = pattern.signatures(spark.createDataFrame([(r["key"], r["canonical"]) for r in made], "key long, canonical string")).collect()
    assert sorted((r["key"], *(r[f"c{i}"] for i in range(4))) for r in made) == sorted(map(tuple, want))


def test_f2_f7_texts_are_split_in_the_workers(spark, docs):
    for df in (features.canonical_forms(docs, "doc_id"), features.patterns(docs, features.fit_vocabulary(docs), "doc_id"), features.fit_vocabulary(docs)):
        assert "regexp_extract_all" not in plan(df) and "md5" not in plan(df) and "lower" in plan(df)


def test_f2_vocabulary_counts_long_words(spark):
    rows = spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id long, text string")
    each = rows.select("doc_id", F.explode(text.long_words(F.col("text"))).alias("term"))
    want = each.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df"))
    got = features.fit_vocabulary(rows).select("term", "tf", "df")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_f7_few_row_groups_are_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    spark.range(3000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(0, 3000, 1, 32).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    monkeypatch.setattr(tables, "SPLIT_BYTES", 1 << 10)
    monkeypatch.setattr(tables, "input_bytes", lambda df: 100 << 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "RoundRobinPartitioning(100)" in plan(tables.spread(one)) and tables.spread(one).count() == 3000
        assert "Exchange" not in plan(tables.spread(many))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_f9_terms_are_counted_in_the_workers(spark, fresh):
    rows = spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id long, text string")
    df = index.term_frequency(rows)
    assert "split(" not in plan(df) and sorted(map(tuple, df.collect())) == sorted(map(tuple, index.document_frequency(index.term_table(rows)).collect()))
    made = indexes.stored_terms(spark, SF)
    assert made.count() == index.term_table(tables.documents(spark, SF)).select("term").distinct().count()
