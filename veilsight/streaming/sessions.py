"""Turns grouped into sessions as a stream, with a state a key and timers by event time.

Events may come out of order within the watermark's delay: they wait in the key's state until the watermark has passed
them, and are then numbered in the order of their times.  A gap longer than ``gap`` begins a session.  What a key's state
holds is the events that wait and one row for its open session, which a timer drops when nothing can go on with it.  A key has
one timer at a time, for its first event or its open session, so its events are read once a micro-batch and not once an event.

However the input is cut into micro-batches, the turns are those of one batch; events behind the watermark are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Fixed value: the store that Spark asks for where a key has states and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The session with the state store that these streams need, as it was afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Turns(StatefulProcessor):
    """key -> (key, begin, turn, at, item) of each event once it can't be overtaken any more."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, item bigint")
        self.open = handle.getValueState("open", "begin bigint, last bigint, turn bigint")
        self.due = handle.getValueState("due", "at bigint")

    def _wake(self, at: int) -> None:
        """The key's one timer: at ``at``, unless it goes off before."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is not None and due <= at:
            return
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = [(r.at, r.item) for r in rows]
        if events:
            self.waiting.appendList(events)
            self._wake(min(events)[0] + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        k = bisect_left(events, (mark,))
        ready, later = events[:k], events[k:]
        begin, last, turn = self.open.get() if self.open.exists() else (None, None, None)
        for at, item in ready:
            if last is None or at - last > self.gap:
                begin, turn = at, -1
            last, turn = at, turn + 1
            yield Row(key=key[0], begin=begin, turn=turn, at=at, item=item)
        if ready:
            self.open.update((begin, last, turn))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self._wake(later[0][0] + 1)
        elif last is not None and last + self.gap < mark:
            self.open.clear()
        elif last is not None:
            self._wake(last + self.gap + 1)

    def close(self) -> None:
        pass


def turns(events: DataFrame, key: str, item: str, ts: str = "ts", gap: int = 1800, late: str = "10 minutes") -> DataFrame:
    """key, begin and at (milliseconds), turn (from 0) and item of a stream of events; ``gap`` in seconds.

    ``item`` is an event's number, which tells events of one time apart.  Needs ``rocksdb`` around its start."""
    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(item).cast("long").alias("item"), ts)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(Turns(gap * 1000), f"key {kind}, begin bigint, turn bigint, at bigint, item bigint", "Append", "EventTime")


def turns_of_table(events: DataFrame, key: str, item: str, ts: str = "ts", gap: int = 1800) -> DataFrame:
    """The same of a table at rest, by windows."""
    rows = events.select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(item).cast("long").alias("item"))
    order = Window.partitionBy("key").orderBy("at", "item")
    rows = rows.withColumn("_new", (F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(gap * 1000 + 1)) > gap * 1000).cast("int"))
    rows = rows.withColumn("_no", F.sum("_new").over(order))
    own = Window.partitionBy("key", "_no").orderBy("at", "item")
    return rows.select("key", F.first("at").over(own).alias("begin"), (F.row_number().over(own) - 1).cast("long").alias("turn"), "at", "item")
