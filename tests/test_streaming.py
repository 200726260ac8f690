"""Streams give what their batch twins give."""

import math

from pyspark.sql import functions as F

from vellumspark.operators import metrics
from vellumspark.operators.index import term_table
from vellumspark.streaming.streams import decayed_weights_stream, index_stream, metrics_stream


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    rows = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: rows.extend(b.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(120), out
    return rows


def test_metrics_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:{s:02d}", float(m * 10 + s), "view" if s % 2 else "click") for m in range(4) for s in range(0, 50, 7)] + [("2024-01-01 01:00:00", 1.0, "view")]
    src = str(tmp_path / "in")
    write(spark, rows, "ts string, value double, kind string", src)
    stream = spark.readStream.schema("ts string, value double, kind string").parquet(src)
    got = run(metrics_stream(stream, "value", F.col("kind") == "view"), tmp_path)
    batch = metrics.tumbling(spark.createDataFrame(rows, "ts string, value double, kind string"), "value", F.col("kind") == "view", "60 seconds").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))[:-1]  # the last window is still open


def test_decayed_weights(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("b", "2024-01-01 00:00:05")], "key string, ts string", src)
    stream = spark.readStream.schema("key string, ts string").parquet(src)
    got = {r["key"]: r["weight"] for r in run(decayed_weights_stream(stream, "key", 0.1), tmp_path, "update")}
    assert abs(got["a"] - (1 + math.exp(-1))) < 1e-9 and got["b"] == 1.0


def test_index_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "postings")
    write(spark, [(1, "a b a"), (2, None)], "doc_id long, text string", src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    assert index_stream(stream, out, str(tmp_path / "ck")).awaitTermination(120) is not False
    write(spark, [(3, "b c")], "doc_id long, text string", src)
    index_stream(stream, out, str(tmp_path / "ck")).awaitTermination(120)
    got = sorted((r["doc_id"], r["term"]) for r in spark.read.parquet(out).collect())
    want = term_table(spark.createDataFrame([(1, "a b a"), (2, None), (3, "b c")], "doc_id long, text string"))
    assert got == sorted(map(tuple, want.select("doc_id", "term").collect()))
