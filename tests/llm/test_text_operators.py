"""Small tables with nulls, empty and long texts, ties, repeated rows, and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vellumspark.llm import bpe, chat_format, fingerprint, language_id, license_scan, mixing, url_filter
from vellumspark.llm.licenses import KNOWN, MIT_BODY


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# chat formatting


def turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string, spans int")


def test_chat_round_trip_and_loss(spark):
    bad = "\\### Assistant: </turn> ok\\l\\\\<turn:user>\n\\g"
    data = [
        (1, 0, "system", None, "x", 1), (1, 1, "user", bad, "x", 1), (1, 2, "assistant", bad, "x", 1), (1, 3, "user", "", "x", 1), (1, 4, "assistant", "é😀", "x", 1),
        (2, 0, "user", "only", "x", 1), (3, 0, None, "t", "x", 1), (3, 0, "assistant", "b", "x", 1), (3, 0, "assistant", "a", "x", 1), (3, 0, "assistant", "a", "x", 1), (4, 0, "a>b<\\g", "x" * 300_000, "x", 1),
        (None, 0, "assistant", "n", "x", 1),
    ]
    formatted = chat_format.format_conversations(turns(spark, data))
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x, *_ in data if c == conv), key=lambda z: (z[0], z[1], z[2]))
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss)


def test_chat_examples_have_all_context_and_one_target(spark):
    formatted = chat_format.format_conversations(turns(spark, [(1, k, ("user", "assistant")[k % 2], f"t{k}", "", 0) for k in range(6)]))
    ex = chat_format.expand_examples(formatted).orderBy("turn_no").collect()
    assert [e["target"] for e in ex] == ["t1", "t3", "t5"]
    facts = chat_format.digest(formatted).collect()[0]
    assert (facts["n_examples"], facts["context_chars"]) == (3, sum(len(e["context"]) for e in ex))
    assert facts["last_context_sha256"] == hashlib.sha256(ex[-1]["context"].encode()).hexdigest()
    for e in ex:
        assert e["context"] == "".join(f"<turn:{('user', 'assistant')[k % 2]}>\nt{k}</turn>\n" for k in range(e["turn_no"])) + "<turn:assistant>\n"


def test_chat_empty(spark):
    assert chat_format.digest(chat_format.format_conversations(turns(spark, []))).count() == 0


# url filter


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, rule string, host int, u int, v int")


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    data = [
        (1, "http://a.Example.COM/en/70?x#y", "", "", 0, 0, 0),  # allowed by the longer rule
        (2, "http://a.com/en/1", "", "", 0, 0, 0),  # blocked
        (3, "http://safe.info/z", link.format("http://a.com/en/1"), "", 0, 0, 0),  # alias of 2
        (4, "http://far.info/z", '<meta http-equiv="refresh" content="0; url=http://safe.info/z">', "", 0, 0, 0),  # alias of an alias
        (5, "http://q.net/de/5", link.format("http://far.info/z"), "", 0, 0, 0),  # alias, but allowed by rule
        (6, None, None, "", 0, 0, 0),
        (7, "mailto:x", "", "", 0, 0, 0),
        (8, "http://free.info/", "", "", 0, 0, 0),
        (9, "http://far.info/z", "", "", 0, 0, 0),  # the same url again
        (10, "http://rel.info/a/b?c", link.format("/root"), "", 0, 0, 0),
        (11, "http://rel.info/root", link.format("//a.com/en/1"), "", 0, 0, 0),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages(spark, data)).collect()}
    assert got[1] == ("a.example.com", "/en/70", "example.com/en/7", "allow")
    assert got[2] == ("a.com", "/en/1", "com/en/", "block")
    assert [got[k][3] for k in (3, 4, 5, 8, 9, 10, 11)] == ["block", "block", "allow", "allow", "block", "block", "block"]
    assert got[5][2] == "net/de/"
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")


def test_url_aliases_meet_in_their_normal_form(spark):
    link = '<link rel="canonical" href="{}">'
    data = [
        (1, "http://a.com/en/1?x=1&y=2#top", "", "", 0, 0, 0),
        (2, "http://b.info/", '<link rel="stylesheet" href="s.css">' + link.format("/none") + link.format("HTTP://A.COM/en/1?x=1&amp;y=2"), "", 0, 0, 0),
        (3, "http://B.info#part", "", "", 0, 0, 0),
        (4, "http://c.info/long/" + "p" * 50_000, link.format("http://b.info/none"), "", 0, 0, 0),
        (5, "http://b.info/A", "", "", 0, 0, 0),
        (6, "http://d.info/a", link.format("http://b.info/a"), "", 0, 0, 0),
    ]
    got = dict(rows(url_filter.judge(pages(spark, data)), "page_id", "verdict"))
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


def test_url_equally_long_rules(spark):
    p = pages(spark, [(1, "http://x.org/ab", "", "", 0, 0, 0)])
    assert rows(url_filter.judge(p, rules=[("x.org", "/a", "block"), ("x.org", "/a", "allow")]), "verdict") == [("allow",)]
    assert rows(url_filter.judge(p, rules=[("x.org", "/a", "allow"), ("org", "/ab", "block")]), "verdict", "rule") == [("allow", "x.org/a")]


def test_url_known_edges_and_empty(spark):
    edges = spark.createDataFrame([("http://x.info/", "http://a.org/es/"), (None, "http://x.info/")], "u string, v string")
    p = pages(spark, [(1, "http://x.info/", "", "", 0, 0, 0), (2, "http://a.org/es/", "", "", 0, 0, 0)])
    assert rows(url_filter.judge(p, edges=edges), "page_id", "verdict") == [(1, "block"), (2, "block")]
    assert url_filter.judge(pages(spark, [])).count() == 0


# licence scan


def test_license_digests(spark):
    variants = [
        "Copyright (c) 2019 Somebody\n\n" + MIT_BODY,
        "The MIT License (MIT)\n\n© 2020 A\nCopyright 2020 B\nAll rights reserved.\n" + MIT_BODY.upper().replace("SUBLICENSE", "SUB-LICENSE"),
        MIT_BODY.replace("\n", " ").replace('"', "“"),
        MIT_BODY + " more",
        "",
        None,
        "Licensed under CC BY-NC 4.0",
        "x " * 100_000,
        "Copyright Jane Doe\nCopyright: Acme Widgets, Inc.\n\n" + MIT_BODY,
        "Лицензия. Released under the MIT License.",
    ]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(variants)] + [(0, variants[0], "k", 0)], "doc_id long, text string, license_id string, c int")
    got = rows(license_scan.scan(docs), "doc_id", "license_id")
    assert got == sorted([(0, "MIT"), (0, "MIT"), (1, "MIT (titled, the)"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "CC-BY-NC-4.0 (notice)"), (7, None), (8, "MIT"), (9, None)], key=repr)
    assert license_scan.scan(docs.limit(0)).count() == 0
    known = {r["license_id"] for r in license_scan.known_digests(spark).collect()}
    assert known == set(KNOWN)


def test_licence_files_of_common_licences(spark):
    ids = ["Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "OFL-1.1", "Unlicense"]
    texts = [KNOWN[i] for i in ids]
    texts += [" \n".join(t.split("\n")).upper() for t in texts] + [t + "\nand more" for t in texts]
    apache = KNOWN["Apache-2.0"]
    texts += [apache.replace("[yyyy] [name of copyright owner]", "2020 Somebody"), apache[: apache.index("   APPENDIX:")], "The ISC License\n\nCopyright (c) 2010 A\n\n" + KNOWN["ISC"]]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == ids * 2 + [None] * len(ids) + ["Apache-2.0 (filled)", "Apache-2.0 (terms)", "ISC (titled, the)"]


# mixing


def test_word_count(spark):
    cases = [None, "", " ", "a", " a  b\tc\n", "a\x0b\x0cb\r", "é x y", "\x1c z"]
    import re

    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in cases]


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_targets_and_copies(spark):
    rnd = random.Random(3)
    data = [(i, " ".join("w" for _ in range(rnd.choice([0, 3, 20, 90, 700]))), rnd.choice(["a", "b", "b", "b", "c", "d", None]), "x", 1.0) for i in range(600)]
    data += [(1000, None, "a", "x", 1.0), (1001, "one", "tiny", "x", 1.0), (1002, "", "void", "x", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string, rate double")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    sizes = {}
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(3, 0.01 * want[s]), (s, t, want[s])


def test_mix_follows_priors_and_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], 1.0 + (i % 4)) for i in range(200)], "doc_id long, text string, source string, p double")
    got = mixing.mix(docs, prior="p").collect()
    by = {(r["doc_id"] % 4): r["rate"] for r in got}
    # Source a: priors 1 and 3, 500 words each, target 2000 / 3; source b: priors 2 and 4, target 4000 / 3.
    assert by[2] / by[0] == pytest.approx(3.0, rel=1e-9) and 500 * (by[0] + by[2]) == pytest.approx(2000 / 3, rel=1e-9)
    assert by[3] / by[1] == pytest.approx(2.0, rel=1e-9) and 500 * (by[1] + by[3]) == pytest.approx(4000 / 3, rel=1e-9)
    assert mixing.expand_copies(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rates_by_bisection(spark):
    """Priors and caps that bind: each source's multiplier found by bisection instead."""
    import math

    rnd = random.Random(12)
    stats = {s: [(rnd.choice([0.2, 0.5, 1.0, 2.5, 6.0]) * (k + 1), float(rnd.randint(1, 500))) for k in range(6)] for s in "abcde"}
    targets = {s: rnd.uniform(0.2, 2.8) * sum(m for _, m in rows) for s, rows in stats.items()} | {"e": 3.0 * sum(m for _, m in stats["e"])}
    got = mixing.entropy_balance(
        spark.createDataFrame([(s, p, m) for s, rows in stats.items() for p, m in rows], "source string, prior double, mass double"),
        spark.createDataFrame(list(targets.items()), "source string, target double"),
    )
    got = {r["source"]: r["lam"] for r in got.collect()}
    for s, rows in stats.items():
        reached = lambda lam: sum(m * min(3.0, p * math.exp(lam)) for p, m in rows)  # noqa: B023, E731
        lo, hi = -30.0, 30.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if reached(mid) < targets[s] else (lo, mid)
        assert reached(got[s]) == pytest.approx(targets[s], rel=1e-9)
        if s != "e":
            assert got[s] == pytest.approx(lo, abs=1e-8)
    with pytest.raises(RuntimeError):
        mixing.entropy_balance(spark.createDataFrame([("a", 1.0, 10.0)], "source string, prior double, mass double"), spark.createDataFrame([("a", 25.0)], "source string, target double"), steps=2)


def test_copies_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], 1, 2, "x", 3, "s") for i in range(40)], "doc_id long, text string, source string, copies int, mixed_id int, kept_id string, row_no int, size string")
    assert mixing.expand_copies(docs).columns == docs.columns and mixing.expand_copies(docs.unionAll(docs)).columns == docs.columns


def test_copies_with_repeated_and_null_ids(spark):
    data = [(i if i else None, f"{s} " * 10, s) for s in "ab" for i in range(30)] + [(3, "a " * 10, "a")] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["source"]) for r in mixing.expand_copies(docs).collect()]
    want = brute_targets({"a": 320, "b": 300})
    for s in "ab":
        assert abs(10 * sum(t == s for _, t in got) - want[s]) <= 10
    assert (None, "b") in got
    one = mixing.expand_copies(docs.filter("source = 'a'")).collect()
    assert sorted((r["doc_id"] or 0) for r in one) == sorted([*range(30), 3, 3])


# fingerprints


def test_fingerprint_query_keeps_repeated_and_null_ids(spark, tmp_path):
    data = [(None, "Abc"), (None, "x"), (5, "abc"), (7, "x y"), (7, "X  Y"), (7, "z"), (7, "z"), (9, None)]
    spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.query(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((i or 0, fingerprint.fingerprint(t)) for i, t in data)
    assert {(r["doc_id"], r["group_id"]) for r in got if r["fingerprint"] == fingerprint.fingerprint("abc")} == {(None, 5), (5, 5)}


def test_fingerprints_against_brute_force(spark):
    texts = ["Ａbc  x", "abc X", "ABC x", "straße", "STRASSE", None, "", " \n", "é", "é", "long " * 30_000, "ﬁn", "fin", "z"]
    docs = spark.createDataFrame([(i * 3 + 1, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in fingerprint.against_next(docs, ranges=5).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        new = fingerprint.edited(t, following)
        r = got[i * 3 + 1]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.fingerprint(t) and r["edited_fingerprint"] == fingerprint.fingerprint(new)
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(t, new), fingerprint.likeness(t, following))
    groups = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(docs).collect()}
    for i, t in enumerate(texts):
        assert groups[i * 3 + 1] == min(j * 3 + 1 for j, u in enumerate(texts) if fingerprint.canonical(u) == fingerprint.canonical(t))


def test_fingerprints_compare_bytes_inside_equal_buckets(spark):
    texts = ["a", "b", "A", None, "b", "", "c", "a "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(docs, digest=lambda form: "x" if form in (b"a", b"b") else form.hex()).collect()}
    assert groups == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1, 5: 3, 6: 6, 7: 0}


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(5, "abcd", "c")], "doc_id long, text string, x string")
    assert fingerprint.against_next(one).collect()[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.against_next(one.limit(0)).count() == 0 and fingerprint.exact_groups(one.limit(0)).count() == 0
    named = spark.createDataFrame([(f"n{k:03}", f"text {k}") for k in range(60)], "doc_id string, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.against_next(named, ranges=7).collect()}
    assert got == {f"n{k:03}": hashlib.sha256(fingerprint.edited(f"text {k}", f"text {(k + 1) % 60}").encode()).hexdigest() for k in range(60)}
    twice = spark.createDataFrame([(5, "a", "c"), (5, "a", "c"), (None, "b", "c")], "doc_id long, text string, x string")
    assert fingerprint.against_next(twice, ranges=3).count() == 3


# BPE


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Coder(ranks, pattern)


ALPHABET = list("aaabc 's'll  \n\n\t,.-19é😀ßИ漢 　\x1c\x85 ́") + ["the ", " der", "\r\n", "    "]


def test_bpe_as_the_library(tools):
    theirs, ours = tools
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60)))
        ids = ours.encode_piece(text)
        assert ids == theirs.encode_ordinary(text), repr(text)
        assert ours.decode(ids).decode() == text


def test_bpe_stitching(tools):
    theirs, ours = tools
    rnd = random.Random(6)
    for k in range(600):
        text = "".join(rnd.choices(ALPHABET if k % 3 else ["ab", "  ", "x"], k=rnd.randint(0, 300)))
        if k % 5 == 0:
            text = text[:50] + "a" * 150 + text[50:] + " " * 90
        chunk = rnd.randint(8, 60)
        assert bpe.encode_stitched(text, ours, chunk=chunk, overlap=rnd.randint(4, chunk)) == theirs.encode_ordinary(text), repr(text)


def test_bpe_boundaries_by_length(tools):
    import regex

    rnd = random.Random(8)
    for pattern in (bpe.default_vocabulary()[1], r"[a-z]+", r"a|b"):
        compiled = regex.compile(pattern)
        for _ in range(300):
            text = "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40)))
            found, sizes = bpe.matches(text, compiled)
            assert found == bpe.boundaries(text, compiled.finditer)
            coder = bpe.Coder({bytes([b]): b for b in range(256)}, pattern)
            lo, hi = sorted(rnd.choices(found, k=2))
            assert coder.encode_range(text, sizes, lo, hi) == coder.encode_range(text, None, lo, hi) or pattern == bpe.default_vocabulary()[1]
            if pattern == bpe.default_vocabulary()[1]:
                assert coder.decode(coder.encode_range(text, sizes, lo, hi)).decode() == text[lo:hi]


def test_bpe_merge_as_the_library(tools):
    theirs, ours = tools
    rnd = random.Random(9)
    for _ in range(4000):
        piece = "".join(rnd.choices(ALPHABET, k=rnd.randint(1, 30))).encode()
        assert bpe.merge(piece, ours.ranks) == theirs._encode_single_piece(piece)


def test_bpe_long_pieces(tools):
    theirs, ours = tools
    for text in ("a" * 20_000, "ab" * 9_000, "\n" * 5_000, "漢" * 3_000):
        assert bpe.merge(text.encode(), ours.ranks) == theirs._encode_single_piece(text)


def test_bpe_distributed(spark, tools, monkeypatch):
    theirs, _ = tools
    rnd = random.Random(7)
    words = ["the", "Straße", "it's", "naïve", "12345", "\n\n", "  ", "—", "x"]
    long = ["".join(rnd.choice(words) + " " for _ in range(n)) for n in (20_000, 60_000, 9_000)] + ["a" * 100_000, "b" * 40_000 + " c" * 50_000]
    texts = [None, "", "short", *long, long[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in bpe.encode(docs, *bpe.default_vocabulary(), keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = theirs.encode_ordinary(t or "")
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), *bpe.default_vocabulary()).count() == 0


# language identification


def test_language_id(spark):
    rnd = random.Random(9)
    letters = {"xx": "abcde", "yy": "fghij", "zz": "éèàçù"}
    word = lambda lang: "".join(rnd.choices(letters[lang], k=rnd.randint(2, 6)))
    data = [(i, " ".join(word(lang) for _ in range(rnd.randint(5, 60))), lang, "m", 0.1) for i in range(300) for lang in [rnd.choice(list(letters))]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.fit(docs.filter("doc_id < 200"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, lang, *_ in data)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !?", "q"), (4, "漢字" * 50, "q"), (5, "abcde " * 50_000, "q"), (5, "abcde " * 50_000, "q")], "doc_id long, text string, score string")
    odd_rows = sorted(language_id.predict(odd, model).collect(), key=lambda r: r["doc_id"])
    assert [(r["lang_pred"], r["score"]) for r in odd_rows[:3]] == [("und", 0.0)] * 3
    assert odd_rows[3]["rejected"] and odd_rows[3]["lang_pred"] in letters and not odd_rows[4]["rejected"] and tuple(odd_rows[4]) == tuple(odd_rows[5])
    assert language_id.predict(odd.limit(0), model).count() == 0
    blank = language_id.fit(docs.filter("lang is null"))
    assert {r["lang_pred"] for r in language_id.predict(odd, blank).collect()} == {"und"}
    kept = language_id.with_language(docs, model)
    assert set(docs.columns) <= set(kept.columns) and kept.count() == len(data)


def _plain_vector(text):
    """Hashed n-grams of a text, one at a time."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    data = (" " + " ".join(words) + " ").encode()
    mult = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
    counts = {}
    for n in (1, 2, 3, 4):
        for i in range(len(data) - n + 1):
            code = ((int.from_bytes(data[i : i + n], "big") * mult[n - 1] + n) % 2**32) >> 17
            counts[code] = counts.get(code, 0) + 1
    return counts


def test_language_id_against_brute_force(spark):
    import math

    rnd = random.Random(10)
    letters = {"xx": "abcdefg", "yy": "efghijk", "zz": "aeiouéè"}
    text = lambda lang, n: " ".join("".join(rnd.choices(letters[lang], k=rnd.randint(2, 6))) for _ in range(n))
    data = [(i, text(lang, rnd.randint(1, 40)), lang) for i in range(150) for lang in [rnd.choice(list(letters))]]
    data += [(1000 + i, *data[0][1:]) for i in range(40)] + [(2000, "12", "xx"), (2001, None, "xx")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    vectors = {(lang, t): _plain_vector(t) for _, t, lang in data if t and t != "12"}
    idf = {}
    for code in {c for v in vectors.values() for c in v}:
        idf[code] = math.log((1 + len(vectors)) / (1 + sum(code in v for v in vectors.values()))) + 0.05
    assert all(model.idf[c] == pytest.approx(x, rel=1e-5) for c, x in idf.items())
    assert model.centroids.shape[1] == len(model.owner) <= 4 * len(model.langs) and model.langs == ("xx", "yy", "zz")
    asked = [(i, text(rnd.choice(list(letters)), rnd.randint(1, 30)), None) for i in range(80)]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    for i, t, _ in asked:
        w = {c: math.log1p(n) * float(model.idf[c]) for c, n in _plain_vector(t).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        cos = [sum(x * float(model.centroids[c, k]) for c, x in w.items()) / norm for k in range(len(model.owner))]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert got[i]["score"] == pytest.approx(cos[best], abs=1e-4)
        if sorted(cos)[-1] - sorted(cos)[-2] > 1e-4:
            assert got[i]["lang_pred"] == model.langs[model.owner[best]]


def test_language_id_ties_and_many_languages(spark):
    same = [(i, "abc abd", lang) for i, lang in enumerate(["q", "p", "q", "p"])]
    docs = spark.createDataFrame(same, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"p"}
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" * 3, f"l{i}") for i in range(250)], "doc_id long, text string, lang string")
    assert len(language_id.fit(many).langs) == 250


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.query(spark, "/root/testdata/sf0.001").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 50 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and not any(r["rejected"] for r in got)
