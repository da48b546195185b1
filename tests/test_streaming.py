from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lavra.streaming import rates

T0 = dt.datetime(2026, 1, 1)


def _events(spark, path):
    rows = [(i, 1, T0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 59, 60, 61, 200))]
    spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp").coalesce(1).write.parquet(path)
    return rows


def test_recent_counts(spark, tmp_path):
    _events(spark, str(tmp_path / "e"))
    out = rates.recent_counts(spark.read.parquet(str(tmp_path / "e")), "user_id", "ts", 60).orderBy("event_id").collect()
    assert [r["recent"] for r in out] == [1, 2, 3, 4, 4, 5, 1]


def test_limiter_stream(spark, tmp_path):
    _events(spark, str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id int, user_id int, ts timestamp").parquet(str(tmp_path / "e"))
    q = rates.admitted(stream, "user_id", "ts", 3, 60).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["admitted"] for r in spark.sql("select * from admitted order by ts").collect()] == [True, True, True, False, True, False, True]


def test_sliding_and_once(spark, tmp_path):
    _events(spark, str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id int, user_id int, ts timestamp").parquet(str(tmp_path / "e"))
    doubled = rates.once(stream.union(stream), ["event_id"], "ts")
    q = rates.sliding_rates(doubled, "user_id", "ts", 60, 30, late=None).writeStream.format("memory").outputMode("append").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_backfill(spark, tmp_path):
    _events(spark, str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id int, user_id int, ts timestamp").parquet(str(tmp_path / "e"))
    q = rates.backfill(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda b: b.withColumn("filled", F.lit(True)))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
