"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each document i of size s_i gets a rate r_i >= 0. Among all rates with sum(r_i s_i) = target of each source,
entropy balancing takes those least far from the prior rates p_i, in sum(s_i (r log(r / p) - r + p)), with
r <= cap. The convex dual has one multiplier a source and r_i = min(cap, p_i exp(lambda_source)): exponentially tilted
rates. Newton's method climbs the dual; each iteration is one pre-aggregated grouping over the
documents' statistics. The rates are then rounded into whole copies: each document takes floor(r_i), and the fractional
copies go to the documents first in a hashed order, as far as the target reaches.

Defined cases: a null text has size 0, rate of its source and no words to take; a null source is a source of its own, sorted last;
repeated rows are documents of their own; an empty table gives an empty result; a source without words has target 0; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, materialize, numbered_if_odd, table

#: No source's target and no document's copies exceed this multiple of their size.
CAP = 3
#: Newton steps at most, and the relative error at which they end.
NEWTON_STEPS, TOLERANCE = 60, 1e-12
#: Bins of the rounding threshold: what a source's last bin holds is about this share of it.
BINS = 1 << 16
#: Passes that cut the line: the first over all documents in it, the others over those that still fit.
FILLS = 3


def word_count(text: Column) -> Column:
    """The number of runs of other than ASCII white space; counted as places where such a run starts."""
    spaced = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    single = F.regexp_replace(spaced, " {2,}", " ")
    return (F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit(""))) - F.when(F.endswith(single, F.lit(" ")), 1).otherwise(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weights 1, 2, 3, repeating by sorted source, sharing the total.

    A target stops at ``cap`` times its source's size; the excess is reshared by weight until none is above. That is the
    level m with sum(min(cap size, m weight)) = total, found in order of cap size / weight. Its windows order all sources in one
    task, at one short row a source: meant for up to some ten million sources, not for one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("reach", F.col("most") / F.col("w"))
    up = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("reach").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level)
    # The first source that its cap does not bind sets the level.
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct(F.col("place"), F.col("level")))).over(whole)
    s = s.withColumn("place", F.row_number().over(up)).withColumn("m", first["level"])
    return s.select("source", "source_size", F.least(F.col("most"), F.col("m") * F.col("w")).alias("target"))


def entropy_balance(stats: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``source, lam``: the dual's multipliers, by Newton's method from 0. ``stats`` has ``source, prior, mass``: words by prior rate, which is all the dual depends on.

    A source whose target its caps do not let it reach ends at the caps; steps that run out are an error.
    """
    rows = materialize(stats)
    none = F.lit(None).cast("double")
    lam = targets.select("source", "target", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"))
    for _ in range(steps):
        tilted = F.col("prior") * F.exp("lam")
        met = rows.withColumnRenamed("source", "of").join(lam, F.col("of").eqNullSafe(F.col("source")))
        sums = met.groupBy("source", "target", "lam", "lo", "hi").agg(
            F.sum(F.col("mass") * F.least(F.lit(float(cap)), tilted)).alias("got"),
            F.sum(F.when(tilted < cap, F.col("mass") * tilted).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("target") - F.col("got")
        # A source that its caps keep below the target stays at the caps.
        ended = (F.abs(gap) <= tolerance * F.greatest(F.lit(1.0), F.col("target"))) | ((F.col("slope") <= 0) & (gap > 0))
        low, high = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + gap / F.when(F.col("slope") > 0, F.col("slope"))
        # Where caps bend the dual, a step that leaves the bracket of the multipliers tried is replaced by the bracket's middle.
        within = F.coalesce(newton > low, newton.isNotNull()) & F.coalesce(newton < high, newton.isNotNull())
        tried = F.when(within, F.greatest(F.col("lam") - 2, F.least(F.col("lam") + 2, newton))).otherwise(F.coalesce((low + high) / 2, F.col("lam") + 2 * F.signum(gap)))
        lam = materialize(sums.select("source", "target", F.when(ended, F.col("lam")).otherwise(tried).alias("lam"), low.alias("lo"), high.alias("hi"), ended.alias("ended")))
        if not lam.filter("not ended").head(1):
            return lam.select("source", "lam")
    raise RuntimeError(f"the dual did not converge in {steps} Newton steps")


def mix(docs: DataFrame, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", prior: str | None = None) -> DataFrame:
    """``doc_id, size, source, source_size, target, rate, copies, taken`` of each document."""
    names = {"doc_id": doc_id, "text": text, "source": source} | ({"prior": prior} if prior else {})
    rows = columns(docs, **names)
    prior_rate = F.coalesce(F.col("prior").cast("double"), F.lit(1.0)) if prior else F.lit(1.0)
    rows = materialize(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), prior_rate.alias("prior"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**52)).alias("h")))
    stats = rows.groupBy("source", "prior").agg(F.sum("size").cast("double").alias("mass"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, cap))
    lam = entropy_balance(stats, targets, cap)
    plan = materialize(targets.join(lam.withColumnRenamed("source", "of"), F.col("of").eqNullSafe(F.col("source")), "left").drop("of"))
    rate = F.least(F.lit(float(cap)), F.col("prior") * F.exp("lam"))
    rated = rows.withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("of").withColumn("rate", rate)
    # Rates within rounding of a whole number are that number.
    rated = rated.withColumn("base", F.least(F.lit(cap), F.floor(F.col("rate") + 1e-9)).cast("int"))
    rated = rated.withColumn("frac", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    # A document is in line for one more copy by its hash over its fraction: small fractions wait longer.
    in_line = F.when((F.col("frac") > 1e-9) & (F.col("base") < cap) & (F.col("size") > 0), (F.col("h") + 1) / F.lit(2.0**52) / F.col("frac"))
    rated = rated.withColumn("key", in_line)
    extra = _thresholds(rated, plan)
    out = rated.withColumnRenamed("source", "of").join(extra, F.col("of").eqNullSafe(F.col("xsource")), "left").withColumnRenamed("of", "source")
    more = F.when(F.col("key").isNotNull() & (_taken() | ((F.col("key") == F.col("last_key")) & (F.col("doc_id") == F.col("last_id")))), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("base") + more).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _taken() -> Column:
    """Whether a document in line is taken by one of the cuts, each for documents of up to so many words."""
    out = F.lit(False)
    for k in range(FILLS):
        out = out | ((F.col("key") < F.col(f"cut{k}")) & (F.col("size") <= F.col(f"most{k}")))
    return out


def _thresholds(rated: DataFrame, plan: DataFrame) -> DataFrame:
    """``xsource``, what ``_taken`` needs, ``last_key, last_id``: which documents get one more copy; the last is the one that best fills what is left.

    The keys of a source are cut into bins, and sums by bin say how far the target reaches: a source sends one row a bin and
    task at most, never its documents to one place.
    """
    based = rated.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("got"))
    room = plan.select(F.col("source").alias("xsource"), "target").join(based, F.col("xsource").eqNullSafe(F.col("source")), "left")
    room = room.select("xsource", (F.col("target") - F.coalesce("got", F.lit(0))).alias("room"))
    # The target is met near key 1 by design; beyond 2 no bin is cut.
    waiting = rated.filter("key is not null").select(F.col("source").alias("of"), "doc_id", "size", "key")
    met = F.col("of").eqNullSafe(F.col("xsource"))
    state = room.select("xsource", "room", *[F.lit(0.0).alias(f"cut{k}") for k in range(FILLS)], *[F.lit(-1.0).alias(f"most{k}") for k in range(FILLS)])
    for k in range(FILLS):
        # First all documents in line; then, behind the cut so far, those that still fit what is left.
        last = F.lit(0.0) if k == 0 else F.col(f"cut{k - 1}")
        open_ = waiting.filter("key < 2").join(state, met).filter((F.col("key") >= last) & (F.lit(True) if k == 0 else F.col("size") <= F.col("room")))
        bins = open_.groupBy("of", F.floor(F.col("key") / 2 * BINS).cast("int").alias("bin")).agg(F.sum("size").alias("words"))
        upto = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("of").orderBy("bin"))).join(state.select("xsource", "room"), met).filter("upto <= room")
        full = upto.groupBy("of").agg(F.max("bin").alias("full"), F.max("upto").alias("used"))
        cut = F.greatest(last, (F.coalesce("full", F.lit(-1)) + 1) * 2 / F.lit(BINS))
        others = [c for j in range(FILLS) for c in (f"cut{j}", f"most{j}") if j != k]
        most = F.lit(float("inf")) if k == 0 else F.col("room").cast("double")
        joined = state.join(full, met, "left").select("xsource", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), cut.alias(f"cut{k}"), most.alias(f"most{k}"), *others)
        state = materialize(joined)
    gap = F.abs(F.col("room") - F.col("size"))
    near = waiting.join(state, met).filter(~_taken() & (gap < F.col("room")))
    best = near.groupBy("xsource").agg(F.min(F.struct(gap.alias("gap"), F.col("key").alias("last_key"), F.col("doc_id").alias("last_id"))).alias("b"))
    out = state.join(best.withColumnRenamed("xsource", "bsource"), F.col("xsource").eqNullSafe(F.col("bsource")), "left")
    return materialize(out.select("xsource", *[c for k in range(FILLS) for c in (f"cut{k}", f"most{k}")], F.col("b.last_key").alias("last_key"), F.col("b.last_id").alias("last_id")))


def expand_copies(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns are those of ``docs``."""
    rows, key = numbered_if_odd(docs)
    chosen = mix(rows, cap, doc_id=key).select(F.col("doc_id").alias("_vellum_mixed"), F.col("copies").alias("_vellum_copies")).filter("_vellum_copies > 0")
    met = rows.join(chosen, rows[key] == F.col("_vellum_mixed"))
    return met.withColumn("_vellum_no", F.explode(F.sequence(F.lit(1), F.col("_vellum_copies").cast("int")))).select(*[rows[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
