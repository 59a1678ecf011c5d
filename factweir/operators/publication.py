"""Changing published history: retractions with an audit trail, backfills that touch changed rows, and idempotent writes.

Tables are Parquet folders; a change is a new version of rows, never an edit in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a retraction's reason.
REASON_LEAST, REASON_MOST = 10, 500


def retract(runs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, audit) after requests(request_id, run_id, action, by, reason, at), action `retract` or `unretract`.

    A succeeded run that isn't retracted can be, with a reason of ten characters or more; a retracted one can be
    unretracted. Of several requests for a run the first counts. audit has a row for each request with its outcome.
    """
    reason = F.left(F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), r"\s+", " ")), F.lit(REASON_MOST))
    asked = requests.select("request_id", "run_id", "action", "by", reason.alias("reason"), "at")
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("request_id"))
    state = runs.select("run_id", "company_id", "status", F.coalesce("retracted", F.lit(False)).alias("was"))
    seen = asked.withColumn("nth", first).join(state, "run_id", "left")
    down = F.col("action") == "retract"
    outcome = (
        F.when(F.col("status").isNull(), "no such run")
        .when(F.col("nth") > 1, "another request came first")
        .when(down & (F.col("status") != "succeeded"), "only a completed run can be retracted")
        .when(down & F.col("was"), "already retracted")
        .when(down & (F.length("reason") < REASON_LEAST), "reason too short")
        .when(~down & ~F.col("was"), "not retracted")
        .otherwise("done")
    )
    audit = seen.select("request_id", "run_id", "company_id", F.concat(F.lit("run_"), "action", F.lit("ed")).alias("event"), "by", "reason", "at", outcome.alias("outcome"))
    done = audit.where("outcome = 'done'").select("run_id", (F.col("event") == "run_retracted").alias("_now"))
    after = runs.join(done, "run_id", "left").withColumn("retracted", F.coalesce("_now", "retracted")).drop("_now")
    return after.select(*runs.columns), audit


def pointer_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Companies whose current run (`runs.current`) differs between two replays: company_id, current_before, current_after."""
    b, a = before.select("company_id", F.col("current_run").alias("current_before")), after.select("company_id", F.col("current_run").alias("current_after"))
    return b.join(a, "company_id", "full").where(~F.col("current_before").eqNullSafe(F.col("current_after")))


def publish_backfill(runs: DataFrame, replayed: DataFrame) -> DataFrame:
    """Only the runs whose stored flag differs from the replayed history: run_id, was, published."""
    shown = replayed.select("run_id", F.lit(True).alias("shown"))
    r = runs.where("status = 'succeeded'").join(shown, "run_id", "left").select("run_id", F.col("published").alias("was"), F.coalesce("shown", F.lit(False)).alias("published"))
    return r.where(~F.col("was").eqNullSafe(F.col("published")))


def aligned_summaries(runs: DataFrame) -> DataFrame:
    """run_id and summary (a map): `ranked` becomes the stored flag; the first copy stays as `ranked_original`.

    runs(run_id, ranked, summary); only rows that change.
    """
    flag = F.coalesce("ranked", F.lit(False)).cast("string")
    stored = F.try_element_at("summary", F.lit("ranked"))
    kept = F.coalesce(F.try_element_at("summary", F.lit("ranked_original")), stored)
    base = F.map_filter("summary", lambda k, _: ~k.isin("ranked", "ranked_original"))
    added = F.when(kept.isNull(), F.create_map(F.lit("ranked"), flag)).otherwise(F.create_map(F.lit("ranked"), flag, F.lit("ranked_original"), kept))
    return runs.where(~stored.eqNullSafe(flag)).select("run_id", F.map_concat(base, added).alias("summary"))


def added_companies(proposed: DataFrame, companies: DataFrame, key: str = "name_key") -> DataFrame:
    """Rows of proposed whose key isn't there yet, one for each key (the smallest proposal): what get-or-create adds."""
    new = proposed.join(companies.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.min("proposal_id").alias("proposal_id"))


def write_children(rows: DataFrame, folder: str) -> None:
    """Replaces the children of the runs in `rows`, folder by folder of run_id; other runs stay.

    Running it again changes nothing. A run's old rows go even if its new ones are fewer.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def append_log(events: DataFrame, folder: str) -> None:
    """Appends to the audit log; nothing that is there is read or changed."""
    events.write.mode("append").parquet(folder)


def expire_days(spark: SparkSession, folder: str, before: str) -> int:
    """Deletes the folders day=... before a day (yyyy-mm-dd) and says how many there were; no rows are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("day=") and f.getPath().getName()[4:] < before]
    for path in old:
        fs.delete(path, True)
    return len(old)


def legacy_companies(companies: DataFrame, scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Companies with scores of the old kind: some score that names no run, or a run with an old pipeline version."""
    old = runs.where(F.col("version").isNull() | ~F.col("version").like("pipeline-v2%")).select("company_id")
    orphan = scores.where("run_id IS NULL").select("company_id")
    return companies.join(old.unionByName(orphan).distinct(), "company_id", "left_semi").select("company_id")
