"""Writes that change history, and the stateful guards."""

from collections import defaultdict

from factweir.operators import publication as pub
from factweir.operators import records
from factweir.streaming import views as v
from pyspark.sql import functions as F


def test_children_are_replaced_by_run_and_days_expire(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run_id int, x string")
    for _ in range(2):
        pub.write_children(rows, f"{tmp_path}/kids")
    pub.write_children(spark.createDataFrame([(1, "z")], "run_id int, x string"), f"{tmp_path}/kids")
    assert sorted((r.run_id, r.x) for r in spark.read.parquet(f"{tmp_path}/kids").collect()) == [(1, "z"), (2, "c")]
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "day string, n int")
    days.write.partitionBy("day").parquet(f"{tmp_path}/days")
    assert pub.expire_days(spark, f"{tmp_path}/days", "2024-01-03") == 2
    assert spark.read.parquet(f"{tmp_path}/days").count() == 1
    for _ in range(2):
        pub.append_log(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6


def test_retractions_change_runs_once(spark):
    runs = spark.createDataFrame([(1, 9, "succeeded", None), (2, 9, "failed", None), (3, 9, "succeeded", True)], "run_id long, company_id long, status string, retracted boolean")
    asked = [(1, 1, "retract", "a good reason here"), (2, 1, "unretract", "changed my mind"), (3, 2, "retract", "a good reason here"), (4, 3, "unretract", ""), (5, 77, "retract", "a good reason here")]
    after, audit = pub.retract(runs, spark.createDataFrame([(i, r, a, "x", w, "t") for i, r, a, w in asked], "request_id long, run_id long, action string, by string, reason string, at string"))
    assert {r.run_id: r.retracted for r in after.collect()} == {1: True, 2: None, 3: False}
    assert [r.outcome for r in audit.orderBy("request_id").collect()] == ["done", "another request came first", "only a completed run can be retracted", "done", "no such run"]


def test_pointer_changes(spark):
    b = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "company_id long, current_run long")
    a = spark.createDataFrame([(1, 6), (2, None), (4, 1)], "company_id long, current_run long")
    assert {r.company_id: (r.current_before, r.current_after) for r in pub.pointer_changes(b, a).collect()} == {1: (5, 6), 3: (7, None), 4: (None, 1)}


def test_count_maps_and_fields(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    a = F.create_map(F.lit("x"), F.lit(1).cast("long"))
    b = F.create_map(F.lit("x"), F.lit(2).cast("long"), F.lit("y"), F.lit(3).cast("long"))
    assert one(records.merged_counts(a, b)) == {"x": 3, "y": 3}
    assert one(records.merged_counts(F.lit(None).cast("map<string,bigint>"), b)) == {"x": 2, "y": 3}
    assert one(records.with_fields(F.struct(F.lit(1).alias("a")), a=F.lit(2), b=F.lit("n"))).asDict() == {"a": 2, "b": "n"}
    assert one(records.wait_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:01.5").cast("timestamp"))) == 1500


def _stream(spark, rows, schema, tmp_path, name, f):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{i}")
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_login_throttle_matches_brute_force(spark, tmp_path):
    rows = [[(f"ip{k % 3}", 1000 * b + k, 1e9 + b * 900.0 + k * 20.0, (k * 7 + b) % 5 != 0) for k in range(40)] for b in range(3)]
    got = {r.event_id: (r.allowed, r.wait_seconds) for r in _stream(spark, rows, "ip string, event_id long, s double, failed boolean", tmp_path, "logins", lambda s: v.login_throttle(s, "ip", most=3, window=300, lockout=200))}
    fails, until, want = defaultdict(list), defaultdict(float), {}
    for ip, i, t, failed in sorted((x for part in rows for x in part), key=lambda x: (x[2], x[1])):
        wait = max(0, -int(-(until[ip] - t) // 1))
        want[i] = (wait == 0, wait)
        if wait:
            continue
        fails[ip] = [m for m in fails[ip] if m > t - 300] + [t] if failed else []
        if len(fails[ip]) >= 3:
            fails[ip], until[ip] = [], t + 200
    assert got == want and any(not a for a, _ in want.values())
