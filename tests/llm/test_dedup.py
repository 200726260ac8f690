import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vellumspark.llm import minhash, substring_dedup
from vellumspark.llm.graph import connected_components
from vellumspark.llm.suffix_array import suffix_array


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2400)] + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components({n for e in real for n in e}, real)
    assert connected_components(df.limit(0)).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, components(list(sets), links)


def family(rnd, n, size, words, edits):
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = [None, "", "  \t", "One two", "one  TWO", "three", "a b c d e", "A B\nC D E", "É b c d e", "é b c d e", "x " * 30_000]
    texts += family(rnd, 60, 60, 120, 4) + family(rnd, 25, 25, 300, 12) + family(rnd, 12, 12, 40, 1)
    texts += [" ".join(f"u{rnd.randint(0, 9999)}" for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    texts += texts[20:60]
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, sig string, key int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    sets, want = brute(docs)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids_are_neither_lost_nor_multiplied(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    data = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, b), (4, c), (4, a), (5, None), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in data], "doc_id long, text string, component string, row int, kept string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=repr) == sorted(((i, len(shingle_set(t))) for i, t in data), key=repr)
    members = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["n_shingles"]), key=repr)
    assert members == sorted([(1, 1, True), (1, 1, False), (2, 1, False), (4, 1, False), (4, 4, True), (None, None, True), (None, None, False), (3, None, False)], key=repr)
    assert all(r["kept"] for r in got if not r["n_shingles"])
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, a), (0, b), (4, c), (5, ""), (5, ""), (0, "")])


def test_hub_edges_are_salted(spark, monkeypatch):
    from vellumspark.llm import graph

    monkeypatch.setattr(graph, "HUB", 50)
    test_components(spark)


def test_large_bucket_without_a_common_hub(spark):
    """A chain of texts, each like its neighbours alone: stars miss links, blocks must find them."""
    rnd = random.Random(4)
    words = [f"c{k}" for k in range(1200)]
    texts = [" ".join(words[4 * k : 4 * k + 200]) for k in range(60)]
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == brute(docs)[1]


def test_minima_estimate_similarity():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rnd.integers(0, 1 << 63, 100, dtype=np.uint64)])
    est = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(est - 900 / 1100) < 0.15


def test_suffix_array_against_sorting():
    rnd = random.Random(1)
    for _ in range(3000):
        n, a = rnd.randint(0, 60), rnd.choice([1, 2, 3, 8])
        s = [rnd.randint(0, a) for _ in range(n)]
        assert suffix_array(s) == sorted(range(n), key=lambda i: s[i:])
    for s in ([0] * 500, [0, 1] * 300, [1, 0] * 300, list(range(300)), list(range(300, 0, -1))):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_cut(docs):
    seen, out = set(), {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randint(15, 60)) for _ in range(6)] + [text(22)[:99], text(40)[:100], text(40)[:101]]
    texts = [None, "", "short", "a" * 100, "a" * 99, "b" * 500, "ab" * 200, "abc" * 150, "ba" * 90]
    for _ in range(80):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            p = rnd.choice(passages)
            if rnd.random() < 0.4:
                k = rnd.randrange(len(p))
                p = p[:k] + rnd.choice("xyz") + p[k + rnd.randint(0, 2) :]
            parts.append(p if rnd.random() < 0.6 else text(rnd.randint(1, 50)))
        texts.append(rnd.choice([" ", "", "\n"]).join(parts))
    texts += texts[20:30]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, seed):
    docs = list(enumerate(corpus(seed)))
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in docs], "doc_id long, text string, bucket string, at int").repartition(5)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, keep_text=True, carry=["bucket", "at"]).collect()}
    want = brute_cut(docs)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
    assert all(r["bucket"] == "z" and r["at"] == 3 for r in got.values())
    assert all((r["kept_text"] or "") == want[i][4].decode("utf-8", "ignore") for i, r in got.items())


def test_repeats_with_repeated_and_null_ids(spark):
    a, b = "q" * 40 + "".join(map(str, range(100))), "zz"
    data = [(None, a), (7, a), (7, a), (7, b), (9, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    removed = defaultdict(list)
    for r in got:
        removed[r["doc_id"]].append(r["n_removed"])
    assert removed[None] == [0] and sorted(removed[7]) == [0, len(a), len(a)] and removed[9] == [0]
    named = spark.createDataFrame([("k", a), ("j", a)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(named).collect()} == {"j": 0, "k": len(a)}
    assert substring_dedup.remove_repeats(named.limit(0)).count() == 0


def test_a_frequent_line_in_many_texts(spark):
    rnd = random.Random(8)
    line = "This line of less than a hundred bytes stands in each and every one of these texts. "
    texts = ["".join(rnd.choices("abcdef ", k=80)) + line + "".join(rnd.choices("abcdef ", k=80)) for _ in range(400)]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: w[1:3] for i, w in brute_cut(docs).items()}


def test_frequent_middle_parts_are_split(spark, monkeypatch):
    """With thresholds so low that all steps run: the bytes are those of brute force all the same."""
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choices("ab ", k=n))
    lines = [noise(n) for n in (66, 80, 92, 97, 99)]
    texts = [noise(rnd.randint(0, 60)) + rnd.choice(["", " ", "b"]) + rnd.choice(lines) + rnd.choice(["", "a", "ab", "b a"]) + noise(rnd.randint(0, 60)) for _ in range(600)] + corpus(3)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    steps = []
    real = substring_dedup._split_frequent
    monkeypatch.setattr(substring_dedup, "MANY_RUNS", 1)
    monkeypatch.setattr(substring_dedup, "FREQUENT", 3)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "_split_frequent", lambda frequent, rest, into, n: steps.append((rest, into)) or real(frequent, rest, into, n))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {i: w[:4] for i, w in brute_cut(docs).items()}
    assert steps == [(34, 4), (4, 0)]
