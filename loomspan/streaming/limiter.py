"""Rate limiters over event streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_window(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """(event_id, admitted) of events(event_id, user_id, ts): a hit is admitted if fewer than `most` admitted hits of its
    key lie within the `seconds` up to it. Hits that are turned away don't count, so that the decision depends on
    earlier ones: an ordered fold for each key, with at most `most` times in hand, over sorted batches of the key."""

    def fold(batches):
        recent: list[float] = []
        key = None
        for pdf in batches:
            admitted = []
            for user, t in zip(pdf["user_id"], pdf["t"]):
                if user != key:
                    key, recent = user, []
                recent = [x for x in recent if x > t - seconds]
                ok = len(recent) < most
                if ok:
                    recent.append(t)
                admitted.append(ok)
            yield pd.DataFrame({"event_id": pdf["event_id"], "admitted": admitted})

    x = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    # Keys stay whole in a partition and in order; batches stream, so that a busy key is never held at once.
    return x.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(fold, "event_id long, admitted boolean")


def sliding_window_stream(events: DataFrame, most: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """The same decisions from a stream: a key's state is the times of the hits admitted last, at most `most`, and goes when
    the watermark passes the last of them by `seconds`, with no hit of the key's own. Hits of a key are decided in order of
    time within a micro-batch; one that comes later than others of its key were decided is judged by what was admitted."""

    def decide(key, batches, state):
        recent = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        admitted = []
        for t in rows["t"]:
            ok = sum(t - seconds < x <= t for x in recent) < most
            if ok:
                recent = sorted([*recent, float(t)])[-most:]
            admitted.append(ok)
        if recent:
            state.update((recent,))
            state.setTimeoutTimestamp(max(int((recent[-1] + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "admitted": admitted})

    ts = F.col("ts").cast("timestamp")
    x = events.select("event_id", "user_id", ts.alias("ts"), (F.unix_micros(ts) / 1e6).alias("t")).withWatermark("ts", late)
    return x.groupBy("user_id").applyInPandasWithState(decide, "event_id long, user_id long, admitted boolean", "recent array<double>", "append", "EventTimeTimeout")


def mean_gaps(events: DataFrame, least: float) -> DataFrame:
    """(user_id, gap) of events(user_id, ts): the mean time in seconds from one event to the next, where an event closer
    than `least` to the last one kept is left out; null for a key of which one alone is kept. One number is in hand."""

    def fold(batches):
        key, last, total, n = None, None, 0.0, 0
        for pdf in batches:
            done = []
            for user, t in zip(pdf["user_id"], pdf["t"]):
                if user != key:
                    if key is not None:
                        done.append((key, total / n if n else None))
                    key, last, total, n = user, t, 0.0, 0
                elif t - last >= least:
                    last, total, n = t, total + t - last, n + 1
            yield pd.DataFrame(done, columns=["user_id", "gap"]).astype({"gap": "float64"})
        if key is not None:
            yield pd.DataFrame([(key, total / n if n else None)], columns=["user_id", "gap"]).astype({"gap": "float64"})

    x = events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return x.repartition("user_id").sortWithinPartitions("user_id", "t").mapInPandas(fold, "user_id long, gap double")


def fixed_window_stream(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Hits for each key and window of a stream of events(ts, user_id), with a watermark: what a fixed-window limiter
    counts. Append mode gives each window once it can't change any more."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "user_id").agg(F.count("*").alias("hits")).select("user_id", F.col("w.start").alias("window_start"), "hits")
