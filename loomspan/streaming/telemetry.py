"""Events for each client over a bounded queue: what comes after the queue is full, until it is emptied, is dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CAPACITY = 100


def queued(events: DataFrame, tick: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The events(client, seq, ...) that each client gets of each tick: the first ones, as many as its queue holds.

    A client's events of a tick are one group of a window; they are ranked, not collected."""
    place = F.row_number().over(Window.partitionBy("client", *tick).orderBy("seq"))
    return events.withColumn("place", place).where(F.col("place") <= capacity).drop("place")


def telemetry_stream(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, capacity: int = CAPACITY, available_now: bool = False) -> StreamingQuery:
    """A running stream: each micro-batch is a tick, after which queues are empty; deliver(rows, number) gets what is left."""
    writer = events.writeStream.foreachBatch(lambda batch, number: deliver(queued(batch, [], capacity), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
