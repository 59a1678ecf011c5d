from collections import defaultdict

from factweir.operators import traffic
from factweir.sources.derive import derived
from factweir.streaming import views as v
from pyspark.sql import functions as F

from tests.oracle import bag


def _files(spark, data, folder, copies=1):
    """The requests as four files in time order, each row `copies` times."""
    pv = derived(spark, data, "page_views")
    for i in range(4):
        part = pv.where(F.floor(F.col("event_id") / 250) == i)
        for _ in range(copies):
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return pv


def _schema(pv):
    return ", ".join(f"{n} {t}" for n, t in pv.dtypes)


def test_stream_rollup_equals_batch_and_can_run_again(spark, data, tmp_path):
    pv = _files(spark, data, tmp_path, copies=2)
    for _ in range(2):
        requests = v.deduplicated(v.read_requests(spark, f"{tmp_path}/in", _schema(pv), 3))
        v.append_views(requests, f"{tmp_path}/raw", f"{tmp_path}/rolled", f"{tmp_path}/ck").awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/rolled")
    want = traffic.rollup(traffic.classify_views(pv))
    assert bag(got.withColumn("day", F.col("day").cast("string")).toPandas()) == bag(want.withColumn("day", F.col("day").cast("string")).toPandas())


def test_batch_rollup_replaces_days(spark, data, tmp_path):
    views = traffic.classify_views(derived(spark, data, "page_views"))
    today = F.lit("2024-01-20").cast("date")
    for _ in range(2):
        traffic.write_rollup(views, f"{tmp_path}/rolled", today)
    got = spark.read.parquet(f"{tmp_path}/rolled")
    assert got.count() == traffic.rollup(views.where(F.col("day") < today)).count()
    live = traffic.daily(got.select("day", "dim", "key", "ua_class", "views", "visitors"), views, F.lit("2024-01-01").cast("date"), today)
    assert live.count() == traffic.rollup(views.where("day >= DATE '2024-01-01'")).count()


def test_windows_close_by_watermark(spark, data, tmp_path):
    pv = _files(spark, data, tmp_path).withColumn("event_type", F.col("path"))
    requests = v.read_requests(spark, f"{tmp_path}/in", _schema(pv.drop("event_type")), 1).withColumn("event_type", F.col("path"))
    q = v.window_counts(requests, "1 day", "1 day").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = spark.table("windows")
    want = pv.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert got.count() > 0
    assert got.join(want, ["w", "event_type", "n"], "left_anti").count() == 0


def test_rate_limit_matches_brute_force(spark, data, tmp_path):
    pv = _files(spark, data, tmp_path)
    requests = v.read_requests(spark, f"{tmp_path}/in", _schema(pv), 1)
    q = v.rate_limited(requests, "user_agent", limit=2, seconds=3600).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {r.event_id: r.accepted for r in spark.table("limits").collect()}
    taken, want = defaultdict(list), {}
    for r in pv.select("event_id", "user_agent", F.col("ts").cast("timestamp").cast("double").alias("m")).orderBy("m").collect():
        recent = [m for m in taken[r.user_agent] if m > r.m - 3600]
        want[r.event_id] = len(recent) < 2
        taken[r.user_agent] = recent + [r.m] * want[r.event_id]
    assert got == want
