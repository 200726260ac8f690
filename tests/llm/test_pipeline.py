"""The stages one after another on a small table, each checked against brute force on its own input."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from vellumspark.llm import bpe, minhash, mixing

from .test_dedup import brute_cut, components, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    letters = {"xx": "abcde", "yy": "fghij"}
    passage = " ".join("".join(rnd.choices("abcde", k=4)) for _ in range(60))
    data = []
    for i in range(300):
        lang = rnd.choice(list(letters))
        text = " ".join("".join(rnd.choices(letters[lang], k=rnd.randint(2, 6))) for _ in range(rnd.randint(5, 120)))
        if i % 9 == 0:
            text = f"{text} {passage}"
        if i % 7 == 0 and data:
            text = data[rnd.randrange(len(data))][1]
        data.append((i, text, lang, f"s{rnd.choice([0, 0, 0, 1, 2])}", len(text or "")))
    data += [(1000, None, "xx", "s1", 0), (1001, "", None, "s1", 0), (1002, "12 34", "xx", None, 5), (1003, "abc ade", None, None, 7)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_array_dedup", "source_mixing", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        last, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert docs.columns == names or k == 4
        texts = sorted((i, r["text"]) for i, r in before.items())
        if name == "language_id":
            assert set(before) - set(after) == {1000, 1001, 1002}
        elif name == "near_dedup":
            assert set(after) == {i for i, c in brute_from_80(texts)[1].items() if i == c}
        elif name == "suffix_array_dedup":
            cut = brute_cut(texts)
            left = {i: w[4].decode("utf-8", "ignore") for i, w in cut.items() if w[4] or not w[1]}
            assert {i: r["text"] for i, r in after.items()} == left and all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "source_mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(last).collect()}
            got = {}
            for r in rows:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {i: c for i, c in copies.items() if c}
        else:
            path, pattern = bpe.default_vocabulary()
            coder = bpe.Coder(bpe.load_ranks(path), pattern)
            assert len(rows) == last.count()
            for r in rows:
                assert coder.decode(r["ids"]).decode() == before[r["doc_id"]]["text"] and r["n_tokens"] == len(r["ids"])
                assert r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]]["text"] or "").encode()).hexdigest()
    ran = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, ran), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_takes_pairs_from_80_percent(spark):
    """Pairs of similarity 0.78 to 0.90: the stage agrees with brute force at 0.80, the operator alone at 0.85."""
    rnd = random.Random(5)
    data = []
    for k in range(120):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        # One new word changes five of 196 shingles; at 2 to 5 of them the similarity is 0.95 to 0.77.
        b = list(a)
        for at in rnd.sample(range(10, 190, 10), 2 + k % 4):
            b[at] = f"e{rnd.randrange(10**6)}"
        data += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    sets = {i: shingle_set(t) for i, t in data}
    like = {2 * k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(120)}
    assert sum(0.80 <= j < 0.85 for j in like.values()) >= 20 and sum(j < 0.80 for j in like.values()) >= 20
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    gone = lambda least: {i + 1 for i, j in like.items() if j >= least}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert set(sets) - kept == gone(0.80)
    assert {r["doc_id"] for r in minhash.near_duplicates(docs).filter("not kept").collect()} == gone(0.85)


def brute_from_80(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, components(list(sets), links)


def test_near_dedup_with_repeated_and_null_ids(spark):
    words = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    data = [(None, words[0]), (None, words[1]), (7, words[0]), (7, words[2]), (7, words[2]), (7, None), (7, words[3])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, words[0]), (None, words[1]), (7, words[2]), (7, None), (7, words[3])], key=repr)


def test_stages_with_odd_rows(spark, tmp_path):
    """Repeated rows, null and repeated ids, a long text, and columns with the names that stages use inside."""
    rnd = random.Random(21)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))
    data = [(i, text(rnd.randint(8, 60)), "xx", f"s{i % 3}", 1, "k") for i in range(60)]
    data += [(3, text(30), "xx", "s0", 2, "k"), (None, text(30), None, None, 3, "k"), (None, text(40), "xx", None, 4, "k"), (70, text(60_000), "xx", "s1", 5, "k"), (71, None, None, "s1", 6, "k")] + [(80, data[0][1], "xx", "s2", 7, "k")] * 3
    names = "doc_id long, text string, lang string, source string, copies int, kept_id string"
    docs = spark.createDataFrame(data, names).withColumns({c: F.lit(1) for c in ("row_no", "mixed_id", "mixed_no", "lang_score", "bucket", "component", "tag", "n_chars")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append(now.count())
        assert k == 4 or now.columns == docs.columns
    # The null text goes; of the text that four rows share, one row stays; nothing else is lost.
    assert counts[:3] == [67, 64, 64] and counts[4] == counts[3]
    assert {r["doc_id"] for r in now.collect()} <= {r[0] for r in data}
