"""Run history: which run is current, leaderboard, history with deltas, board, queue, spend, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from factweir.shipping import ship

def version_key(version: Column) -> Column:
    """Numbers of a version such as pipeline-v2.10; empty, and so the oldest, if there are none."""
    digits = F.regexp_extract(F.coalesce(version, F.lit("")), r"v([0-9]+(?:[.][0-9]+)*)", 1)
    return F.when(digits == "", F.array().cast("array<int>")).otherwise(F.split(digits, "[.]").cast("array<int>"))


def _sortable(version: Column) -> Column:
    """A version key as text in the same order."""
    return F.array_join(F.transform(version, lambda n: F.lpad(n.cast("string"), 10, "0")), ".")


def decide(ranked: Column, coverage: Column, has_previous: Column, previous_ranked: Column, previous_coverage: Column, has_legacy: Column) -> Column:
    """Whether a run is published, given the current one."""
    zero = F.lit(0.0)
    return F.when(ranked, True).when(has_previous, ~previous_ranked & ~(F.coalesce(previous_coverage, zero) > F.coalesce(coverage, zero))).otherwise(~has_legacy)


_FOLDED = ("company_id", "stretch", "reset", "seen", "now_ranked", "coverage", "version", "clean", "has_legacy")
_KEPT = ("company_id", "run_id", "finished_at", "undone")


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their stretches, with `public`; only the current run is held."""
    stretch, current = None, None
    for batch in batches:
        public = []
        for company, part, reset, seen, ranked, coverage, version, clean, legacy in zip(*(batch.column(c).to_pylist() for c in _FOLDED), strict=True):
            if (company, part) != stretch:
                stretch, current = (company, part), None
            if reset:
                show = True
            elif current is None:
                show = seen and legacy is False
            else:
                again = seen and not current[0] and not current[1] > (coverage or 0.0)
                show = again or (clean and version > current[2])
            if show:
                current = (ranked, coverage or 0.0, version)
            public.append(show)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(public, pa.bool_())], names=[*_KEPT, "public"])


def replay(runs: DataFrame, companies: DataFrame) -> DataFrame:
    """A row for each public run: company_id, run_id and the company's current run; nothing for a company without one.

    Retracted runs are out; runs after a retraction are decided anew; a clean run of a newer pipeline
    replaces the current one; if a retraction leaves nothing, the last remaining run is current.

    A run that is public whatever is current starts a stretch that depends on no earlier run. Stretches are
    numbered by counts a day and then a running sum over a company's days, so the runs of one company are
    spread over tasks by day and by stretch. Each stretch is read as a sorted stream with one run in memory.
    """
    ship(runs.sparkSession)
    no = F.lit(False)
    r = runs.where("status = 'succeeded'").join(companies.select("company_id", "has_legacy"), "company_id").select(
        "company_id", "run_id", "finished_at", "has_legacy", F.coalesce("retracted", no).alias("retracted"), F.coalesce("ranked", no).alias("ranked"), F.coalesce("is_ranked", no).alias("now_ranked"),
        F.col("coverage").cast("double").alias("coverage"), F.coalesce("published", no).alias("published"), _sortable(version_key(F.col("version"))).alias("version"),
        (~F.coalesce("degraded", no) & (F.coalesce("basis", F.lit("")) != "energy_unreadable")).alias("clean"),
        F.coalesce(F.to_date(F.col("finished_at").cast("timestamp")), F.lit("0001-01-01").cast("date")).alias("day"),
    )
    at = F.struct("finished_at", "run_id")
    first = r.where("retracted").groupBy("company_id").agg(F.min(at).alias("first_retracted"))
    r = r.join(first, "company_id", "left").withColumns({"undone": F.col("first_retracted").isNotNull(), "seen": F.coalesce(at > F.col("first_retracted"), no)})
    r = r.withColumn("reset", F.when(F.col("seen"), F.col("ranked")).otherwise(F.col("published")))
    r = r.where(~F.col("retracted") & (F.col("reset") | F.col("clean") | F.col("undone")))  # others are not public and change nothing

    resets = F.sum(F.col("reset").cast("long"))
    days = r.groupBy("company_id", "day").agg(resets.alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("company_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("company_id", "day", before.alias("before"))
    inside = resets.over(Window.partitionBy("company_id", "day").orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("inside", inside).join(days, ["company_id", "day"]).withColumn("stretch", F.col("before") + F.col("inside"))

    r = r.select(*dict.fromkeys([*_KEPT, *_FOLDED]))
    schema = StructType([*r.select(*_KEPT).schema.fields, StructField("public", BooleanType())])
    rows = r.repartition("company_id", "stretch").sortWithinPartitions("company_id", "stretch", "finished_at", "run_id").mapInArrow(_shown, schema)
    public = F.max(F.when(F.col("public"), at))["run_id"]
    ends = rows.where("public OR undone").groupBy("company_id").agg(F.coalesce(public, F.when(F.max("undone"), F.max(at)["run_id"])).alias("current_run"))
    shown = rows.select("company_id", "run_id", "public").join(ends, "company_id")
    return shown.where(F.col("public") | (F.col("run_id") == F.col("current_run"))).select("company_id", "run_id", "current_run")


def current(replayed: DataFrame) -> DataFrame:
    """company_id and current_run of each company that has one."""
    return replayed.where("run_id = current_run").select("company_id", "current_run")


def leaderboard(companies: DataFrame, runs: DataFrame, replayed: DataFrame, q: str | None = None, limit: int = 100) -> DataFrame:
    """Ranked companies by index, then by name."""
    if q:
        pattern = F.lit(f"%{q}%")
        companies = companies.where(F.ilike("name", pattern) | F.ilike("industry", pattern) | F.ilike("country", pattern))
    got = companies.join(current(replayed).withColumnRenamed("current_run", "run_id"), "company_id").join(runs.where("is_ranked").select("run_id", "index_score", "coverage", "confidence"), "run_id")
    top = got.orderBy(F.coalesce("index_score", F.lit(0.0)).desc(), "name").limit(limit)
    place = F.row_number().over(Window.orderBy(F.coalesce("index_score", F.lit(0.0)).desc(), "name"))  # `limit` rows
    return top.select(place.alias("place"), "company_id", "name", "run_id", "index_score", "coverage", "confidence")


def label(offset: Column) -> Column:
    """N for the current run, N-1 for the one before, N+1 for the one after."""
    return F.when(offset == 0, "N").otherwise(F.concat(F.lit("N"), F.when(offset > 0, "+").otherwise(""), offset.cast("string")))


def history(runs: DataFrame, replayed: DataFrame) -> DataFrame:
    """Public runs of each company with ordinals, labels, and the change against the latest earlier ranked run."""
    r = replayed.join(runs.select("run_id", "finished_at", "index_score", "coverage", "is_ranked"), "run_id")
    r = r.where("run_id = current_run OR NOT (coalesce(coverage, 0) = 0 AND index_score IS NULL)")
    by = Window.partitionBy("company_id").orderBy("finished_at", "run_id")
    r = r.withColumn("ordinal", F.row_number().over(by)).withColumn("on", F.col("is_ranked") & F.col("index_score").isNotNull())
    at = F.max(F.when(F.col("run_id") == F.col("current_run"), F.col("ordinal"))).over(Window.partitionBy("company_id"))
    before = F.last(F.when(F.col("on"), F.struct("index_score", "ordinal")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumns({"at": at, "before": before})
    delta = F.when(F.col("on") & F.col("before").isNotNull(), F.col("index_score") - F.col("before.index_score"))
    return r.select("company_id", "run_id", "ordinal", label(F.col("ordinal") - F.col("at")).alias("label"), (F.col("run_id") == F.col("current_run")).alias("is_current"), delta.alias("delta"), F.when(delta.isNotNull(), label(F.col("before.ordinal") - F.col("at"))).alias("delta_vs"))


def withheld(runs: DataFrame, replayed: DataFrame, n: int = 3) -> DataFrame:
    """The latest n succeeded runs after the current one that aren't public."""
    since = current(replayed).join(runs.select(F.col("run_id").alias("current_run"), F.col("finished_at").alias("since")), "current_run").select("company_id", "since")
    later = runs.where("status = 'succeeded' AND NOT retracted").join(replayed, "run_id", "left_anti").join(since, "company_id", "left").where("since IS NULL OR finished_at > since")
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("finished_at"), F.desc("run_id")))
    return later.withColumn("place", place).where(F.col("place") <= n).select("company_id", "run_id", "place")


def sparkline(rows: DataFrame, width: float = 120.0, height: float = 28.0) -> DataFrame:
    """rows(key, seq, value) to points: x from the place in the series, y from the range 0 to 10; gaps stay."""
    by = Window.partitionBy("key")
    n = F.count(F.lit(1)).over(by)
    i = F.row_number().over(by.orderBy("seq")) - 1
    x = F.when(n > 1, i * width / (n - 1)).otherwise(width / 2)
    return rows.select("key", "seq", x.alias("x"), (height - F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("value"))) / 10 * height).alias("y"))


def board(companies: DataFrame, runs: DataFrame, replayed: DataFrame, min_confidence: float = 0.2) -> DataFrame:
    """A card for each company: latest, active and retracted run, number of runs, and its group."""
    idle = ~F.col("status").isin("queued", "running")
    card = runs.groupBy("company_id").agg(
        F.max(F.when(idle, F.struct("run_id", "status", "error_type"))).alias("latest"),
        F.max(F.when(~idle, F.col("run_id"))).alias("active_run"),
        F.max(F.when(F.col("retracted"), F.col("run_id"))).alias("retracted_run"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    now = current(replayed).join(runs.select(F.col("run_id").alias("current_run"), "is_ranked", "basis", "degraded", F.col("confidence").alias("conf")), "current_run")
    c = companies.select("company_id", "name").join(card, "company_id", "left").join(now, "company_id", "left")
    failed = (F.col("latest.status") == "failed") & (F.col("current_run").isNull() | (F.col("latest.run_id") > F.col("current_run")))
    group = F.when(F.col("is_ranked"), "ranked").when(F.col("basis") == "energy_unreadable", "energy").when(failed | F.col("degraded"), "degraded").when(F.col("conf") <= min_confidence, "confidence").otherwise("coverage")
    return c.select("company_id", "name", "current_run", F.col("latest.run_id").alias("latest_run"), "active_run", "retracted_run", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), group.alias("group"))


def queue(runs: DataFrame, companies: DataFrame) -> DataFrame:
    """Active runs with their company and bucket."""
    bucket = F.when(F.col("status") == "running", "running").when(F.col("run_trigger") == "energy_retry", "scheduled").otherwise("queued")
    return runs.where(F.col("status").isin("queued", "running")).join(companies, "company_id").select("run_id", "company_id", "name", bucket.alias("bucket"))


def spend(runs: DataFrame, since: Column) -> DataFrame:
    """Recorded cost since a moment: sum of what is known (null if nothing is), runs, and runs without a cost."""
    return runs.where(F.col("finished_at") >= since).agg(F.sum("cost_cents").alias("cents"), F.count(F.lit(1)).alias("n_runs"), (F.count(F.lit(1)) - F.count("cost_cents")).alias("unknown"))


def outcomes(runs: DataFrame, since: Column) -> DataFrame:
    """Runs by outcome in a window; a succeeded run can count several times."""
    ok = F.col("status") == "succeeded"
    names = F.array(
        F.when(F.col("status") == "failed", F.concat(F.lit("failed:"), F.coalesce("error_type", F.lit("unknown")))),
        F.when(ok, "succeeded"),
        F.when(ok & F.col("degraded"), "degraded"),
        F.when(ok & (F.col("basis") == "energy_unreadable"), "energy_unreadable"),
        F.when(ok & ~F.coalesce("published", F.lit(False)), "withheld"),
        F.when(ok & (F.col("claims_verified") == 0), "zero_claims"),
    )
    return runs.where(F.col("finished_at") >= since).select(F.explode(F.array_compact(names)).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def alerts(runs: DataFrame, replayed: DataFrame, since: Column, n: int = 200) -> DataFrame:
    """(run_id, kind) over the latest n runs that are recent or active; a run can be in several lists."""
    recent = runs.where((F.col("finished_at") >= since) | F.col("status").isin("queued", "running")).orderBy(F.desc("run_id")).limit(n)
    shown = replayed.select("run_id", F.lit(True).alias("shown"))
    r = recent.join(shown, "run_id", "left")
    ok = F.col("status") == "succeeded"
    kinds = F.array(
        F.when(F.col("status") == "failed", "failed"),
        F.when((F.col("status") == "queued") & (F.col("error_type").isNotNull() | (F.col("run_trigger") == "energy_retry")), "retrying"),
        F.when(ok & F.col("degraded"), "degraded"),
        F.when(ok & F.col("shown").isNull() & ~F.col("retracted"), "withheld"),
        F.when(ok & (F.col("basis") == "energy_unreadable"), "energy_unreadable"),
    )
    return r.select("run_id", F.explode(F.array_compact(kinds)).alias("kind"))


def streak(runs: DataFrame, trigger: str) -> DataFrame:
    """How many of a company's latest runs in a row have this trigger."""
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("run_id")))
    r = runs.withColumn("place", place)
    broken = F.min(F.when(F.col("run_trigger") != trigger, F.col("place")))
    return r.groupBy("company_id").agg(F.coalesce(broken - 1, F.count(F.lit(1))).alias("streak"))
