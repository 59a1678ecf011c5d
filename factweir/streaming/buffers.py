"""A bounded buffer between a stream of events and its writer: when it is full the oldest goes and is counted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events that a buffer holds, and seconds between two flushes.
CAPACITY, FLUSH_SECONDS = 5000, 30
#: What transformWithState keeps its state in; set before a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_OUT = ["key", "event_id", "flushed_at", "dropped"]


class _Buffer(StatefulProcessor):
    def __init__(self, capacity: int, seconds: float) -> None:
        self.capacity, self.seconds = capacity, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_id long")
        self.meta = handle.getValueState("meta", "due double, dropped long")

    def _held(self) -> tuple[deque, float, int]:
        due, dropped = self.meta.get() if self.meta.exists() else (0.0, 0)
        return deque(r[0] for r in self.rows.get()) if self.rows.exists() else deque(), due, dropped

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, due, dropped = self._held()
        out: list[tuple] = []
        for moment, event_id in sorted((m, i) for pdf in rows for m, i in zip(pdf["moment"], pdf["event_id"], strict=True)):
            if held and moment >= due:
                out += [(key[0], e, due, dropped) for e in held]
                held.clear()
            if not held:
                due = (moment // self.seconds + 1) * self.seconds
            if len(held) >= self.capacity:
                held.popleft()
                dropped += 1
            held.append(event_id)
        self.rows.put([(int(e),) for e in held])
        self.meta.update((float(due), int(dropped)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(due * 1000))
        yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, due, dropped = self._held()
        self.rows.clear()
        yield pd.DataFrame([(key[0], e, due, dropped) for e in held], columns=_OUT)

    def close(self) -> None:
        pass


def drop_oldest(events: DataFrame, key: str, capacity: int = CAPACITY, seconds: float = FLUSH_SECONDS, late: str = "1 minute") -> DataFrame:
    """events(key, ts, event_id) as a stream to key, event_id, flushed_at (seconds) and dropped, what `key` lost so far.

    A key's events wait until the next multiple of `seconds` in event time, `capacity` of them at most: one more
    pushes out the oldest. A timer flushes keys that fall silent, when the watermark has passed; a batch that holds
    several flushes makes them in order, so results don't depend on how events were batched. State of a key is
    its waiting ids and two numbers; it survives a restart with the checkpoint. Late events are left out. A null key is
    a key of its own.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    timed = events.withWatermark("ts", late).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "ts", F.col("ts").cast("double").alias("moment"), "event_id")
    return timed.groupBy("key").transformWithStateInPandas(_Buffer(capacity, float(seconds)), "key string, event_id long, flushed_at double, dropped long", "append", "eventTime")
