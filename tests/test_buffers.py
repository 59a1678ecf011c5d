"""The bounded buffer against a plain one, in one run and after a restart."""

from collections import defaultdict, deque

from factweir.sources.derive import derived
from factweir.streaming import buffers
from factweir.streaming import views as v
from pyspark.sql import functions as F


def _plain(rows, capacity, seconds):
    """rows: (key, moment, event_id). Flushed (key, event_id, flushed_at, dropped), and ids still waiting."""
    held, due, dropped, out = defaultdict(deque), {}, defaultdict(int), []
    for key, m, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if held[key] and m >= due[key]:
            out += [(key, e, due[key], dropped[key]) for e in held[key]]
            held[key].clear()
        if not held[key]:
            due[key] = (m // seconds + 1) * seconds
        if len(held[key]) == capacity:
            held[key].popleft()
            dropped[key] += 1
        held[key].append(i)
    return out, [(k, e, due[k], dropped[k]) for k, q in held.items() for e in q]


def _run(spark, folder, name, files, schema, capacity, seconds):
    events = v.read_requests(spark, f"{folder}/in", schema, files)
    flushed = buffers.drop_oldest(events, "user_agent", capacity, seconds)
    q = flushed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-ck").option("path", f"{folder}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def test_buffer_in_one_run_and_after_a_restart(spark, data, tmp_path):
    pv = derived(spark, data, "page_views").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 7 == 3, None).otherwise(F.col("user_agent")).alias("user_agent"))
    schema = "event_id long, ts timestamp, user_agent string"
    rows = [(r.user_agent or "", r.m, r.event_id) for r in pv.select("user_agent", F.col("ts").cast("double").alias("m"), "event_id").collect()]
    capacity, seconds = 3, 4 * 3600.0
    want, waiting = _plain(rows, capacity, seconds)
    parts = [pv.where(F.floor(F.col("event_id") / 250) == i) for i in range(4)]
    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    _run(spark, tmp_path, "halves", 1, schema, capacity, seconds)  # stops here, and goes on from its checkpoint
    for p in parts[2:]:
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    _run(spark, tmp_path, "halves", 1, schema, capacity, seconds)
    _run(spark, tmp_path, "whole", 9, schema, capacity, seconds)
    for name in ("halves", "whole"):
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect()))
        assert set(want) <= set(got) and len(set(got)) == len(got), name
        assert set(got) - set(want) <= set(waiting), name  # timers may have flushed the last ones
    assert sum(d for *_, d in want) > 0
