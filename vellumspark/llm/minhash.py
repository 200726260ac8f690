"""Near-duplicate detection by MinHash.

A text's set is its distinct word shingles. Universal hash minima are cut into bands; texts that share a band are
candidates; their signatures are compared, then their full sets; links become components by alternating large-star
and small-star.

Texts with equal sets form one class, of which one text stands for all. Bands' buckets of up to ``SMALL`` classes give
all their pairs; in larger ones all members meet the least one (a star), and members that the found links leave
outside their bucket's largest component meet all its members in blocks, where only a spanning forest of confirmed links
leaves a task. So copies are never expanded into all pairs and no link is given up for a bucket's size.

Two texts of similarity 0.85 share no band with probability 4e-7 (25 bands of 5 minima), and a signature
that far below its expectation as to be dropped (0.65) is as rare. From 0.80 on, 37 bands of 5 minima and 0.63 do the same.

Defined cases: null, empty and wordless texts have the empty set and link with nothing; texts of fewer words than a shingle have
their whole word sequence as one; rows whose doc_ids are null or repeated count as documents of their own in the order of doc_id (null
first) and text: none is lost or multiplied, a component has the doc_id of its first row, and that row alone is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import Ranges, mix
from .common import Scope, columns, discard, materialize, numbered_if_odd, table
from .graph import connected_components

SHINGLE, PERCENT = 5, 85


@dataclass(frozen=True)
class Banding:
    """``bands`` of ``rows`` minima; pairs whose signatures agree in less than ``least_estimate`` are not compared further."""

    bands: int
    rows: int
    least_estimate: float

    @property
    def minima(self) -> int:
        return self.bands * self.rows


#: By the least percentage that they are sized for.
BANDINGS = {85: Banding(25, 5, 0.65), 80: Banding(37, 5, 0.63)}
#: Buckets of up to so many classes give all their pairs; blocks of larger ones have up to so many.
SMALL, BLOCK = 8, 256
#: Bytes of text that are hashed together.
GROUP_BYTES = 1 << 20


def banding(percent: int) -> Banding:
    """The banding of the nearest size at or below ``percent``."""
    sizes = [p for p in BANDINGS if p <= percent]
    if not sizes:
        raise ValueError(f"no banding is sized for {percent} %")
    return BANDINGS[max(sizes)]


@lru_cache
def _factors(plan: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The constants of the minima's hashes and of the keys."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    a = rng.integers(0, 1 << 63, plan.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, plan.minima, dtype=np.uint64)
    c = rng.integers(0, 1 << 63, max(SHINGLE, plan.rows) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, b, c


_C = _factors(BANDINGS[PERCENT])[2]
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))
    starts, ends = edge[::2], edge[1::2]
    words = Ranges(data)(starts, ends)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += words[k : k + n] * _C[k]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mix(np.atleast_1d((words[lo:hi] * _C[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, plan: Banding = BANDINGS[PERCENT]) -> np.ndarray:
    """The minima of the universal hashes (a x + b) >> 32."""
    a, b, _ = _factors(plan)
    least = np.full(plan.minima, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):
        x = shingles[at : at + 1024]
        h = (a[:, None] * x[None, :] + b[:, None]).min(axis=1)
        least = np.minimum(least, (h >> np.uint64(32)).astype(np.uint32))
    return least


def band_keys(signatures: np.ndarray, plan: Banding = BANDINGS[PERCENT]) -> np.ndarray:
    """(n, bands) keys of (n, minima) minima."""
    c = _factors(plan)[2]
    s = signatures.reshape(len(signatures), plan.bands, plan.rows).astype(np.uint64)
    return mix((s * c[: plan.rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, plan.bands + 1, dtype=np.uint64) * c[plan.rows]).view(np.int64)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) in groups of about GROUP_BYTES."""
    first, group, size = 0, [], 0
    for k, t in enumerate(texts):
        group.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= GROUP_BYTES:
            yield first, group
            first, group, size = k + 1, [], 0
    if group:
        yield first, group


def _sketch(plan: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(1).to_pylist()):
                sets = shingle_sets(texts)
                sigs = np.stack([signature(s, plan) for s in sets])
                keys = band_keys(sigs, plan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sigs], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), plan.bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "sig", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _groups(batch.column(1).to_pylist()):
            sets = [s.tobytes() for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def _estimate(plan: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(n).to_pylist()), np.uint32).reshape(-1, plan.minima) for n in ("sig_a", "sig_b"))
                est = (a == b).mean(axis=1)
                keep = pa.array(np.flatnonzero(est >= plan.least_estimate))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep), pa.array(est[est >= plan.least_estimate])], names=["a", "b", "est"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("set_a"), batch.column("set_b")
            keep = pa.array([k for k in range(batch.num_rows) if _linked(np.frombuffer(xs[k].as_buffer(), np.uint64), np.frombuffer(ys[k].as_buffer(), np.uint64), percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return materialize(pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_confirm(percent), f"a {kind}, b {kind}"))


def _blocks(percent: int, plan: Banding):
    """Within one block pair of one bucket: a spanning forest of the links between different components."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps, outer = (table.column(n).to_pylist() for n in ("doc_id", "component", "outer"))
        band = table.column("band")[0].as_py()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, plan.minima)
        keys = band_keys(sigs, plan)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        small = np.asarray(table.column("smalls").to_pylist(), bool).reshape(-1, plan.bands)
        root = {c: c for c in comps}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        inner = np.flatnonzero(~np.asarray(outer, bool))
        for i in np.flatnonzero(np.asarray(outer, bool)):
            est = (sigs[inner] == sigs[i]).mean(axis=1)
            # A pair is compared in the first band that it shares; pairs of small buckets were compared before.
            earlier = (keys[inner, :band] == keys[i, :band]).any(axis=1) | ((keys[inner] == keys[i]) & small[i]).any(axis=1)
            for j in inner[(est >= plan.least_estimate) & ~earlier]:
                x, y = find(comps[i]), find(comps[j])
                if x != y and _linked(sets[i], sets[j], percent):
                    root[x] = y
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        kind = table.schema.field("doc_id").type
        return pa.table([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], names=["a", "b"])

    return run


def _labelled(nodes: DataFrame, members: DataFrame, on: str, to: str) -> DataFrame:
    """``nodes`` with column ``to``: the component of column ``on``, itself where it has none."""
    m = members.select(F.col("node").alias(on), F.col("component").alias("_c"))
    return nodes.join(m, on, "left").withColumn(to, F.coalesce("_c", on)).drop("_c")


def _leftover(mb: DataFrame, classes: DataFrame, members: DataFrame, texts: DataFrame, percent: int, plan: Banding) -> DataFrame | None:
    """Links of large buckets that stars may have missed, or None where no such bucket spans two components."""
    large = materialize(_labelled(mb.filter(F.col("n") > SMALL), members, "doc_id", "component"))
    per = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    main = materialize(main.select("key", F.col("m.component").alias("main")))
    if not main.head(1):
        return None
    split = large.join(main, "key").withColumn("outer", F.col("component") != F.col("main"))
    split = materialize(split.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    ids = split.select("doc_id").distinct()
    sets = materialize(texts.join(ids, "doc_id").mapInArrow(_sets, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, shingles binary"))
    sigs = classes.select(F.col("rep").alias("doc_id"), "sig", "bands")
    data = sets.join(sigs, "doc_id")
    # Which of a class's bands fell into small or single buckets: those pairs have been compared.
    big = data.select("doc_id", F.posexplode("bands").alias("band", "key")).join(mb.filter(F.col("n") > SMALL).select("key").distinct(), "key").groupBy("doc_id").agg(F.collect_set("band").alias("big"))
    data = data.join(big, "doc_id").withColumn("smalls", F.transform(F.sequence(F.lit(0), F.lit(plan.bands - 1)), lambda k: ~F.array_contains("big", k)))
    # Blocks of outer members meet all blocks of their bucket; each row is dealt once for each block it meets.
    row = split.join(data, "doc_id").withColumn("band", F.array_position("bands", F.col("key")).cast("int") - 1)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    outer_blocks = materialize(split.filter("outer").select("key", F.col("own").alias("ob")).distinct())
    left = row.filter("outer").select("key", F.col("own").alias("ob"), F.explode(every).alias("ib"), "doc_id", "component", F.lit(True).alias("outer"), "band", "sig", "shingles", "smalls")
    right = row.join(outer_blocks, "key").select("key", "ob", F.col("own").alias("ib"), "doc_id", "component", F.lit(False).alias("outer"), "band", "sig", "shingles", "smalls")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return materialize(left.unionByName(right).groupBy("key", "ob", "ib").applyInArrow(_blocks(percent, plan), f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document; the component is its least doc_id, which is kept."""
    rows, key = numbered_if_odd(columns(docs, doc_id=doc_id, text=text))
    found = _components(columns(rows, doc_id=key, text="text"), percent)
    if key == "doc_id":
        return found
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("own_id"))
    of = ids.select(F.col("row").alias("component_id"), F.col("own_id").alias("first_id"))
    met = found.join(ids, F.col("doc_id") == F.col("row")).join(of, "component_id")
    return met.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("first_id").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one before them; all columns stay."""
    rows, key = numbered_if_odd(docs)
    kept = _components(columns(rows, doc_id=key, text="text"), percent).filter("kept").select(F.col("doc_id").alias("_vellum_kept"))
    return rows.join(kept, rows[key] == F.col("_vellum_kept"), "left_semi").select(*docs.columns)


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` of rows whose doc_ids are neither null nor repeated. Only two of its tables outlive it."""
    with Scope() as scope:
        light, named = _classes(rows, percent)
    scope.discard(light, named)
    component = F.coalesce("component", "doc_id")
    return light.join(named, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _classes(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, set_key`` of each text, and ``set_key, component`` of each class of equal sets."""
    plan = banding(percent)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketch = materialize(rows.mapInArrow(_sketch(plan), f"doc_id {kind}, n_shingles long, set_key binary, sig binary, bands array<bigint>"))
    light = materialize(sketch.select("doc_id", "n_shingles", "set_key"))
    first = light.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    own = sketch.select(F.col("doc_id").alias("rep"), "set_key", "sig", "bands").join(first, ["rep", "set_key"])
    classes = materialize(own.select("rep", "set_key", "sig", "bands"))
    discard(sketch)
    banded = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).filter("n > 1"))
    mb = materialize(banded.join(buckets, "key"))
    few = mb.filter(F.col("n") <= SMALL).select("key", "doc_id")
    pairs = few.select("key", F.col("doc_id").alias("a")).join(few.select("key", F.col("doc_id").alias("b")), "key").filter("a < b").select("a", "b")
    star = mb.filter((F.col("n") > SMALL) & (F.col("doc_id") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    pairs = pairs.unionByName(star).distinct()
    sig_a, sig_b = (classes.select(F.col("rep").alias(n), F.col("sig").alias(f"sig_{n}")) for n in "ab")
    likely = materialize(pairs.join(sig_a, "a").join(sig_b, "b").mapInArrow(_estimate(plan), f"a {kind}, b {kind}, est double"))
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(rows.join(ids, "doc_id").mapInArrow(_sets, f"doc_id {kind}, shingles binary"))
    # First each text's likeliest partner, then the pairs that the links so far leave in different components.
    best = likely.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = _confirmed(best, sets, percent)
    members = materialize(connected_components(links, "a", "b"))
    rest = _labelled(_labelled(likely.select("a", "b"), members, "a", "ca"), members, "b", "cb").filter("ca <> cb").select("a", "b")
    more = _confirmed(rest, sets, percent)
    if more.head(1):
        links = links.unionByName(more)
        members = materialize(connected_components(links, "a", "b"))
    late = _leftover(mb, classes, members, rows, percent, plan)
    if late is not None and late.head(1):
        members = materialize(connected_components(links.unionByName(late), "a", "b"))
    named = materialize(_labelled(classes.select("set_key", "rep"), members, "rep", "component").select("set_key", "component"))
    return light, named


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
