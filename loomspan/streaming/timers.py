"""Keyed state with timers: leases that run out, and a cache whose entries expire.

Timers are in event time: one fires when the watermark has passed it, so that every later row of its key is later than it, and the same rows come out however the
stream is cut into batches, as long as rows come in order within the watermark's delay. State lives in the RocksDB store on the executors and in the
checkpoint; a timer that fires clears its key's state, so the state holds open leases and live entries only.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from loomspan.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(at: datetime) -> int:
    return round(at.timestamp() * 1_000_000) // 1000


class Leases(StatefulProcessor):
    """The last event of a key renews its lease; a row comes out for each lease that runs out before the next event, or for good."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, at long")

    def _row(self, key: tuple, event_id: int, at: int) -> Row:
        return Row(user_id=key[0], event_id=event_id, expired_ms=at + self.limit)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        for at, event_id in sorted((_millis(r.ts), r.event_id) for r in rows):
            if held is not None and at - held[1] > self.limit:
                yield self._row(key, *held)
            if held is None or at >= held[1]:
                held = event_id, at
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(held)
        self.handle.registerTimer(held[1] + self.limit + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield self._row(key, *self.last.get())
        self.last.clear()

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """A request is a hit while its key's answer is younger than ttl_ms; else it is a miss and stores a new one."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "event_id long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = held = self.stored.get()
        for at, event_id in sorted((_millis(r.ts), r.event_id) for r in rows):
            hit = held is not None and at - held[1] < self.ttl
            if not hit:
                held = event_id, at
            yield Row(event_id=event_id, hit=hit, answer=held[0])
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before[1] + self.ttl)
            self.stored.update(held)
            self.handle.registerTimer(held[1] + self.ttl)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.stored.clear()
        yield from ()

    def close(self) -> None:
        pass


def lease_expiries(stream: DataFrame, limit_ms: int = 600_000, late: str = "0 seconds") -> DataFrame:
    """user_id, event_id (the last before), expired_ms of every lease that runs out, also of those that no event follows.

    Events (user_id, event_id, ts) later than the watermark are dropped; ties of time go by event_id. Null users are one key; ts is not null.
    """
    rows = stream.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithState(Leases(limit_ms), "user_id long, event_id long, expired_ms long", "Append", "EventTime")


def cache_requests(stream: DataFrame, keys: list[str], ttl_ms: int = 7 * 86_400_000, late: str = "0 seconds") -> DataFrame:
    """event_id, hit, answer (the request whose answer is used) for requests of these keys, with entries that expire after ttl_ms."""
    rows = stream.select(*keys, "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy(*keys).transformWithState(Cache(ttl_ms), "event_id long, hit boolean, answer long", "Append", "EventTime")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs such a stream over what there is now and reads its table. A folder given again goes on where the run before ended."""
    spark = stream.sparkSession
    folder, before = folder or shared_folder(spark), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
