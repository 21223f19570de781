"""A rate limit on a stream, in event time: windows that open with a key's own events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StructType


class _Limit(StatefulProcessor):
    """State of a key: its open window, and its events that the watermark has not reached. A timer stands at the latest
    event of each micro-batch; when it fires, all events up to it have come, and are counted in their order. Another
    stands at the end of the window, which is forgotten then."""

    def __init__(self, key: str, at: str, order: list[str], schema: StructType, names: list[str], seconds: int, most: int):
        self.key, self.at, self.order, self.schema, self.names, self.span, self.most = key, at, order, schema, names, seconds * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start_us long, n int")
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            if len(frame):
                self.waiting.appendList([tuple(r) for r in frame[[self.at, *self.order]].itertuples(index=False)])
                top = frame[self.at].max()
                last = top if last is None else max(last, top)
        if last is not None:
            self.handle.registerTimer(_millis(last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in held if _millis(r[0]) <= now)
        start, n = tuple(self.window.get()) if self.window.exists() else (None, 0)
        told = []
        for r in ready:
            t = pd.Timestamp(r[0]).value // 1000
            if start is None or t - start > self.span * 1000:
                start, n = t, 0
            n += 1
            told.append((key[0], *r[1:], pd.Timestamp(start * 1000), n, n <= self.most))
        later = [r for r in held if _millis(r[0]) > now]
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if start is not None and not later and now > start // 1000 + self.span:
            self.window.clear()
        elif ready:
            self.window.update((start, n))
            self.handle.registerTimer(start // 1000 + self.span + 1)
        if told:
            yield pd.DataFrame(told, columns=self.names)

    def close(self) -> None:
        pass


def _millis(t) -> int:
    """The first full millisecond at or after a time."""
    return -(-pd.Timestamp(t).value // 1_000_000)


def stream_rate_limit(events: DataFrame, key: str, at: str, order: list[str], seconds: int = 60, most: int = 20, delay: str = "10 minutes") -> DataFrame:
    """As `state.rate_limit`, of a stream: an event is told when the watermark, `delay` behind the latest one, has
    passed it, so events that are late by less than delay count in their place; those that are later still, and those
    without a time, are dropped by the watermark."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(key, *order, at).withWatermark(at, delay)
    held = StructType([events.schema[c] for c in (at, *order)])
    out = StructType([events.schema[c] for c in (key, *order)])
    out.add("window_start", events.schema[at].dataType).add("window_count", IntegerType()).add("allowed", BooleanType())
    limit = _Limit(key, at, order, held, out.names, seconds, most)
    return rows.groupBy(key).transformWithStateInPandas(limit, out, "append", "eventTime")
