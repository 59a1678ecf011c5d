"""Page views as a stream: capture, deduplication, daily rollup of touched days, and rate limits.

Each writer takes the checkpoint folder of its query; on a cluster that is a shared folder. Batches are
written idempotently, so a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factweir.operators import traffic


def read_requests(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Requests that arrive as Parquet files; the zone-less `ts` is UTC."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, as long as its copies come within `late`; state older than that goes."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_views(requests: DataFrame, raw: str, rolled: str, checkpoint: str):
    """Appends classified views by day under `raw`, and rolls up the days that each batch touches again.

    A batch's own views are written under their day and its id first, replacing what a failed try left; the rollup
    of a touched day is then made from all of that day's views. Late views are thereby counted as they come, and
    a batch reads the folders of its own days, not all history.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        views = traffic.classify_views(df).withColumn("batch", F.lit(batch_id)).persist()
        views.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(raw)
        days = [r["day"] for r in views.select("day").distinct().collect()]  # the few days of a batch
        views.unpersist()
        if days:
            touched = spark.read.option("basePath", raw).parquet(*[f"{raw}/day={d}" for d in days])
            traffic.rollup(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(rolled)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(requests: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests by tumbling event-time window and type, closed by the watermark."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _moments(requests: DataFrame, key: str, late: str, *more: str) -> DataFrame:
    """key, ts (watermarked), moment in seconds and the other columns, for a stateful operator."""
    timed = requests.withWatermark("ts", late)
    return timed.select(F.col(key).cast("string").alias("key"), "ts", F.col("ts").cast("double").alias("moment"), *more)


def _expire(state: GroupState, moment: float) -> None:
    """Ends the state when the watermark passes the moment; at once if it has."""
    at = int(moment * 1000) + 1
    if at > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(at)
    else:
        state.remove()


def rate_limited(requests: DataFrame, key: str, limit: int = 5, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(key, event_id, accepted): an event is accepted if fewer than `limit` were in the `seconds` before it.

    Time is event time; events older than the watermark are late and get no row. State for a key is at most `limit` moments; it goes when the watermark has passed the
    last of them by `seconds`, so a stream that catches up decides as one that ran along.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent: list[float] = list(state.get[0]) if state.exists else []
        rows: list[tuple[Any, int, bool]] = []
        events = sorted((m, i) for pdf in batches for m, i in zip(pdf["moment"], pdf["event_id"], strict=True))
        for moment, event_id in events:
            recent = [m for m in recent if m > moment - seconds]
            accepted = len(recent) < limit
            if accepted:
                recent.append(moment)
            rows.append((group[0], event_id, accepted))
        state.update((recent,))
        _expire(state, max(recent) + seconds)
        yield pd.DataFrame(rows, columns=["key", "event_id", "accepted"])

    timed = _moments(requests, key, late, "event_id")
    return timed.groupBy("key").applyInPandasWithState(run, "key string, event_id long, accepted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def login_throttle(attempts: DataFrame, key: str, most: int = 5, window: int = 900, lockout: int = 900, late: str = "15 minutes") -> DataFrame:
    """attempts(key, ts, event_id, failed) to (key, event_id, allowed, wait_seconds).

    After `most` failures within `window` seconds a key is locked out for `lockout` seconds; attempts in that time
    are refused and don't count. A success clears the key's failures. The guard over all keys is the same operator
    on a constant key. Attempts older than the watermark are late and get no row.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows: list[tuple[Any, int, bool, int]] = []
        events = sorted((m, i, bool(f)) for pdf in batches for m, i, f in zip(pdf["moment"], pdf["event_id"], pdf["failed"], strict=True))
        for moment, event_id, failed in events:
            wait = max(0, math.ceil(until - moment))
            rows.append((group[0], event_id, wait == 0, wait))
            if wait:
                continue
            failures = [m for m in failures if m > moment - window] + [moment] if failed else []
            if len(failures) >= most:
                failures, until = [], moment + lockout
        state.update((failures, until))
        _expire(state, max([until, *(m + window for m in failures)]))
        yield pd.DataFrame(rows, columns=["key", "event_id", "allowed", "wait_seconds"])

    timed = _moments(attempts, key, late, "event_id", "failed")
    return timed.groupBy("key").applyInPandasWithState(run, "key string, event_id long, allowed boolean, wait_seconds int", "failures array<double>, until double", "append", GroupStateTimeout.EventTimeTimeout)
