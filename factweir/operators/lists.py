"""Lists and small reports over runs: pages, pivots, budgets, costs and what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.operators.runs import current


def category_deltas(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, category, delta: the change against the company's run before, in the same category."""
    c = scores.join(runs.select("run_id", "company_id", "finished_at"), "run_id")
    before = F.lag("score").over(Window.partitionBy("company_id", "category").orderBy("finished_at", "run_id"))
    return c.select("run_id", "category", (F.col("score") - before).alias("delta"))


def category_pivot(scores: DataFrame, categories: list[str]) -> DataFrame:
    """A column for each category."""
    return scores.groupBy("run_id").pivot("category", categories).agg(F.max("score"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of ordered rows (from 1), with the number of pages."""
    pages = rows.agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))  # one row
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(pages))


def stale_running(runs: DataFrame, now: Column, tries_left: Column, seconds: int = 180) -> DataFrame:
    """Runs without a sign of life for `seconds`: queued again while tries are left, else failed."""
    quiet = F.col("finished_at") < now - F.make_dt_interval(secs=F.lit(seconds))
    return runs.where((F.col("status") == "running") & quiet).select("run_id", F.when(tries_left, "requeue").otherwise("fail").alias("action"))


def within_budget(rows: DataFrame, order: list[str], budget: int, each: int) -> DataFrame:
    """The first rows that a budget pays for, each at the same cost."""
    return rows.orderBy(*order).limit(budget // each)


def recent_cost(runs: DataFrame, last: int = 10) -> DataFrame:
    """Cost of the latest succeeded runs with one: cents in all and number; their quotient is the mean."""
    rows = runs.where("status = 'succeeded' AND cost_cents > 0").orderBy(F.desc("run_id")).limit(last)
    return rows.agg(F.sum("cost_cents").alias("cents"), F.count(F.lit(1)).alias("n"))


def status_counts(runs: DataFrame) -> DataFrame:
    """Runs and tokens by error type and status."""
    return runs.groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type"), "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def stale_retry_claims(runs: DataFrame, replayed: DataFrame) -> DataFrame:
    """Current runs whose reason promises a retry although none is queued or running."""
    claims = runs.where("NOT is_ranked AND contains(reason, 'retry scheduled')").select("run_id")
    now = current(replayed).withColumnRenamed("current_run", "run_id").join(claims, "run_id")
    return now.join(runs.where("status IN ('queued', 'running')").select("company_id"), "company_id", "left_anti").select("company_id", "run_id")


def company_record(runs: DataFrame) -> DataFrame:
    """The runs of each company, a row each in the order of run_id, beside the company's number of runs, its last run
    and the greatest status with trigger."""
    whole = runs.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.max("run_id").alias("last_run"), F.max(F.concat_ws(":", "status", "run_trigger")).alias("top"))
    return runs.select("company_id", "run_id", "status").join(whole, "company_id")
