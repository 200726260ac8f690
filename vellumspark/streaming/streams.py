"""Streaming twins of the batch operators; each uses the batch function's expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stats import exclusive_quantile
from ..operators.index import term_table


def metrics_stream(rows: DataFrame, latency: str, hit: Column, width: str = "60 seconds", late: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """Mean, p95 and hit rate of tumbling event-time windows, closed by a watermark."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    agg = timed.groupBy(F.window(ts, width).alias("w")).agg(F.sort_array(F.collect_list(latency)).alias("xs"), F.avg(latency).alias("m"), F.avg(hit.cast("int")).alias("h"), F.count(F.lit(1)).alias("n_queries"))
    return agg.select(F.col("w.start").alias("window_start"), "n_queries", F.round("m", 6).alias("avg_time"), F.round(exclusive_quantile(F.col("xs"), 19, 20), 6).alias("p95"), F.round("h", 6).alias("hit_rate"))


def decayed_weights_stream(accesses: DataFrame, key: str, decay: float, ts: str = "ts", late: str = "60 seconds") -> DataFrame:
    """``key, weight, as_of`` after each batch that touches a key: the sum of exp(-decay age) at its latest access.

    A key's state is two numbers: the decayed sum and the time it holds for, since sums of exponentials decay together. Keys that go
    untouched for 5 / decay seconds of event time leave the state.
    """
    import math

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weight, at = state.get if state.exists else (0.0, None)
        for pdf in batches:
            for t in sorted(pdf["t"]):
                if at is None or t >= at:
                    weight, at = (weight * math.exp(-decay * (t - at)) if at is not None else 0.0) + 1.0, t
                else:  # late: its share has decayed since
                    weight += math.exp(-decay * (at - t))
        state.update((weight, at))
        state.setTimeoutTimestamp(max(int((at + 5 / decay) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(k[0])], "weight": [weight], "as_of": [at]})

    timed = accesses.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    keyed = timed.select(F.col(key).cast("string").alias("key"), (F.unix_micros(ts) / 1e6).alias("t"), ts)
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, weight double, as_of double", "weight double, at double", "update", GroupStateTimeout.EventTimeTimeout)


def index_stream(docs: DataFrame, path: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Postings of arriving documents, appended as Parquet under ``path``, a folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, no: int) -> None:
        term_table(batch).write.mode("overwrite").parquet(f"{path}/batch={no}")
        if after:
            after(no)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
