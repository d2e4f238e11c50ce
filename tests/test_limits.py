"""Stateful operators: the sliding limiter as a fold, and the watermarked stream."""

import datetime as dt
import random

from loomspan.streaming.limiter import fixed_window_stream, sliding_window, sliding_window_stream
from tests.test_sources import run_stream

T0 = dt.datetime(2024, 1, 1)


def test_sliding_window_counts_admitted_hits_alone(spark):
    hits = [(1, 7, 0), (2, 7, 1), (3, 7, 2), (4, 7, 3), (5, 7, 9), (6, 7, 11), (7, 8, 3)]
    x = spark.createDataFrame([(e, u, T0 + dt.timedelta(seconds=s)) for e, u, s in hits], "event_id long, user_id long, ts timestamp_ntz")
    found = {r.event_id: r.admitted for r in sliding_window(x, most=3, seconds=10).collect()}
    assert found == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}
    assert sliding_window(x.where("false"), 3, 10).count() == 0


def test_fixed_window_stream(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=s)) for s in (0, 10, 59, 60, 3600)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    query = fixed_window_stream(stream, 60, "1 minute").writeStream.outputMode("append").format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.window_start.minute, r.hits) for r in spark.sql("select * from hits").collect()) == [(0, 3), (1, 1)]


def test_sliding_window_stream_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(3)
    times = sorted((rng.randrange(0, 4000), rng.choice((7, 8, 9))) for _ in range(120))
    hits = [(i, user, T0 + dt.timedelta(seconds=s)) for i, (s, user) in enumerate(times)]
    schema = "event_id long, user_id long, ts timestamp"
    found = run_stream(spark, tmp_path, [hits[i : i + 30] for i in range(0, 120, 30)], "limited", schema, lambda s: sliding_window_stream(s, most=3, seconds=300))
    batch = sliding_window(spark.createDataFrame(hits, schema), most=3, seconds=300)
    assert {(r.event_id, r.admitted) for r in found} == {(r.event_id, r.admitted) for r in batch.collect()} and 0 < sum(r.admitted for r in found) < 120
