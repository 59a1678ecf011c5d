"""Records of runs: status labels, nested documents, evidence lists and counters, and how numbers are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.functions import text

#: Stages in order, those that always run again, and the delays of a retry in minutes.
STAGES = ("resolve", "research", "edgar", "fetch", "extract", "compute", "judge", "aggregate")
ALWAYS_AGAIN = ("compute", "aggregate")
RETRY_MINUTES, RETRY_TRIES = (2, 10, 60), 4
ENERGY_RETRY_HOURS = (6, 24, 72)


def history_status(status: Column, error: Column, retracted: Column, degraded: Column, published: Column) -> Column:
    """What the history calls a run: its status with the error, or retracted, degraded, published or withheld."""
    failed = F.when(error.isNull() | (error == ""), status).otherwise(F.concat(status, F.lit(" ("), error, F.lit(")")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(status != "succeeded", failed).when(yes(retracted), "retracted").when(yes(degraded), "degraded").when(yes(published), "published").otherwise("withheld")


def history_compare(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every run of a company, newest first, with its label, number of sources and change of index against the run before."""
    counts = sources.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sources"))
    by = Window.partitionBy("company_id").orderBy("finished_at", "run_id")
    delta = F.col("index_score") - F.last("index_score", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    label = history_status(*[F.col(c) for c in ("status", "error_type", "retracted", "degraded", "published")])
    r = runs.withColumn("delta", delta).withColumn("label", label).withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("finished_at"), F.desc("run_id"))))
    return r.join(counts, "run_id", "left").select("company_id", "run_id", "place", "label", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "delta")


def is_scheduled(status: Column, next_attempt: Column, now: Column) -> Column:
    return (status == "queued") & F.coalesce(next_attempt > now, F.lit(False))


def is_ready(status: Column, next_attempt: Column, now: Column) -> Column:
    """Queued, and due: no time is set or it has come."""
    return (status == "queued") & (next_attempt.isNull() | (next_attempt <= now))


def next_runs(runs: DataFrame, now: Column, limit: int = 5) -> DataFrame:
    """The first ready runs in the order they came: run_id, place."""
    first = runs.where(is_ready(F.col("status"), F.col("next_attempt"), now)).orderBy("queued_at", "run_id").limit(limit)
    return first.select("run_id", F.row_number().over(Window.orderBy("queued_at", "run_id")).alias("place"))  # `limit` rows


def scheduled_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that wait for their time, with the minutes left."""
    wait = F.ceil((F.unix_micros(F.col("next_attempt").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 60e6)
    return runs.where(is_scheduled(F.col("status"), F.col("next_attempt"), now)).select("run_id", wait.cast("long").alias("minutes"))


def retry_after(attempt: Column) -> Column:
    """Minutes to the next try after this many tries; null when there is none."""
    delays = F.array(*[F.lit(m) for m in RETRY_MINUTES])
    return F.when(attempt < RETRY_TRIES, F.element_at(delays, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_MINUTES))).cast("int")))


def energy_retry_after(tries: Column) -> Column:
    """Hours to the next try of an unreadable energy source after this many retries; null when they are used up."""
    return F.try_element_at(F.array(*[F.lit(h) for h in ENERGY_RETRY_HOURS]), (tries + 1).cast("int"))


def first_pending(done: Column) -> Column:
    """The first stage that isn't done, in order; `compute` when all are, as it runs again."""
    return F.coalesce(F.get(F.array_except(F.array(*[F.lit(s) for s in STAGES]), done), F.lit(0)), F.lit("compute"))


def stages_to_run(done: Column) -> Column:
    """Stages of a resumed run, in order: those not done, and the cheap ones that always run again."""
    return F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: ~F.array_contains(done, s) | s.isin(*ALWAYS_AGAIN))


def wait_millis(start: Column, end: Column) -> Column:
    """Milliseconds between two moments; a moment without a zone is UTC."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)


def run_documents(runs: DataFrame, scores: DataFrame, sources: DataFrame) -> DataFrame:
    """run_id and `document`: the run as a JSON object with its categories in order and its sources by status.

    Categories and statuses of one run are few, so they are collected for each run.
    """
    cats = scores.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", "score", "confidence"))).alias("categories"))
    by_status = sources.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("sources"))
    r = runs.join(cats, "run_id", "left").join(by_status, "run_id", "left")
    body = F.struct("run_id", "company_id", "status", F.struct("index_score", "coverage", "confidence").alias("scores"), F.transform("categories", lambda c: c.dropFields("ordinal")).alias("categories"), "sources")
    return r.select("run_id", F.to_json(body).alias("document"))


def dossier(companies: DataFrame, runs: DataFrame, replayed: DataFrame, scores: DataFrame) -> DataFrame:
    """company_id, name and its current run as a nested row: scores by category in order, and sizes of its history."""
    now = replayed.groupBy("company_id", F.col("current_run").alias("run_id")).agg(F.count(F.lit(1)).cast("int").alias("n_public"))
    cats = scores.join(now.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", "score"))).alias("categories"))
    total = runs.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_runs"))
    current = now.join(runs.select("run_id", "index_score", "coverage", "is_ranked"), "run_id").join(cats, "run_id", "left")
    body = F.struct("run_id", "index_score", "coverage", "is_ranked", "n_public", "categories")
    return companies.select("company_id", "name").join(total, "company_id", "left").join(current.select("company_id", body.alias("current")), "company_id", "left").select("company_id", "name", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "current")


def evidence_lists(owners: DataFrame, evidence: DataFrame) -> DataFrame:
    """owners(owner_id, evidence_ids) to owner_id and quotes, in the order of the ids; ids without evidence are left out."""
    each = owners.select("owner_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(evidence.select("evidence_id", "quote"), "evidence_id")
    listed = each.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("pos", "evidence_id", "quote"))).alias("xs"))
    return owners.select("owner_id").join(listed, "owner_id", "left").select("owner_id", F.coalesce(F.transform("xs", lambda x: x["evidence_id"]), F.array().cast("array<bigint>")).alias("evidence_ids"), F.coalesce(F.transform("xs", lambda x: x["quote"]), F.array().cast("array<string>")).alias("quotes"))


def distinct_evidence(evidence: DataFrame, *more: str) -> DataFrame:
    """The first evidence of each quote (in normal form) and domain, and of the columns in `more`."""
    by = [text.normal_text(F.col("quote")).alias("_normal"), F.col("domain").alias("_domain"), *[F.col(c).alias(f"_{c}") for c in more]]
    return evidence.groupBy(*by).agg(F.min("evidence_id").alias("evidence_id")).select("evidence_id")


def distinct_claims(claims: DataFrame) -> DataFrame:
    """The first claim of each source and matched span."""
    return claims.groupBy("source_id", "start", "end").agg(F.min("claim_id").alias("claim_id")).select("claim_id")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Per run: all evidence, and what of it was verified."""
    return evidence.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"))


def reason_counts(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """key and `reasons`: a map from each reason to its count, reasons in order; rows without a reason don't count."""
    counts = rows.where(F.col(reason).isNotNull()).groupBy(key, reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("reasons"))


def merged_counts(a: Column, b: Column) -> Column:
    """Sum of two maps of counts."""
    zero = F.lit(0).cast("long")
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,bigint>")), F.coalesce(b, F.create_map().cast("map<string,bigint>")), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def with_fields(summary: Column, **fields: Column) -> Column:
    """A struct with fields set or replaced."""
    for name, value in fields.items():
        summary = summary.withField(name, value)
    return summary


def latest_scores(scores: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """scores(entity_id, category, score, model, judged_at, score_id) to entity_id, status, overall, n_scores.

    Of several scores of a category the latest counts, without placeholders; all dimensions make the mean of them
    and a rank, to one decimal.
    """
    real = scores.where((F.coalesce("model", F.lit("")) != "stub") & F.col("category").isin(*dimensions))
    last = real.groupBy("entity_id", "category").agg(F.max_by("score", F.struct("judged_at", "score_id", "score")).alias("score"))
    found = last.groupBy("entity_id").agg(F.count("score").alias("n_scores"), F.sum("score").alias("total"))
    every = scores.select("entity_id").distinct().join(found, "entity_id", "left")
    ranked = F.coalesce(F.col("n_scores") == len(dimensions), F.lit(False))
    return every.select("entity_id", F.when(ranked, "ranked").otherwise("awaiting").alias("status"), F.when(ranked, F.round(F.round(F.col("total") / len(dimensions), 6), 1)).alias("overall"), F.coalesce("n_scores", F.lit(0)).alias("n_scores"))


def alert_total(alerts: DataFrame) -> DataFrame:
    """Number of entries over all alert lists, and by list."""
    return alerts.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a kind


def failures_first(counts: DataFrame) -> DataFrame:
    """outcome, n: the failures among counted outcomes without their prefix, most frequent first."""
    failed = counts.where(F.startswith("outcome", F.lit("failed:")))
    return failed.select(F.regexp_replace("outcome", "^failed:", "").alias("error"), "n").orderBy(F.desc("n"), "error")


def source_order(sources: DataFrame) -> DataFrame:
    """Place of each source in its run's list: primary ones first, then by id."""
    return sources.select("run_id", "source_id", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("is_primary"), "source_id")).alias("place"))


def host_labels(sources: DataFrame, host: Column, status: Column, http: Column, archive: Column, top: int = 10) -> DataFrame:
    """host, total, failed and `labels`: a map of why its sources failed, for the hosts with most failures."""
    failed = status != "ok"
    label = F.when(failed & (status == "dead") & http.isNotNull(), F.concat(F.lit("dead:"), http.cast("string"))).when(failed, status)
    tried = F.when(archive.isNotNull(), F.concat(F.lit("archive:"), archive))
    rows = sources.select(host.alias("host"), failed.alias("failed"), F.array_compact(F.array(label, tried)).alias("labels"))
    sums = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"))
    worst = sums.where("failed > 0").orderBy(F.desc("failed"), "host").limit(top)
    counted = rows.select("host", F.explode("labels").alias("label")).join(F.broadcast(worst.select("host")), "host", "left_semi")  # `top` rows
    return worst.join(reason_counts(counted, "host", "label"), "host", "left").select("host", "total", "failed", F.col("reasons").alias("labels"))


def shown_number(x: Column, digits: int = 2) -> Column:
    """Thousands separators, never an exponent: whole numbers as they are, else fewer decimals the larger it is."""
    few = F.regexp_replace(F.regexp_replace(F.format_number(x, digits), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), "—").when(whole, F.format_number(x, 0)).when(F.abs(x) >= 1e4, F.format_number(x, 0)).when(F.abs(x) >= 100, F.format_number(x, 1)).otherwise(few)


def shown_power(watts: Column) -> Column:
    out = F.concat(F.format_number(watts, 0), F.lit(" W"))
    for unit, scale in (("kW", 1e3), ("MW", 1e6), ("GW", 1e9), ("TW", 1e12)):
        x = watts / scale
        out = F.when(watts >= scale, F.concat(F.when(x < 100, F.format_number(x, 1)).otherwise(F.format_number(x, 0)), F.lit(f" {unit}"))).otherwise(out)
    return out


def shown_energy(joules: Column) -> Column:
    twh = joules / 3.6e15
    return F.when(twh >= 1, F.concat(F.format_number(twh, 2), F.lit(" TWh/yr"))).otherwise(F.concat(F.format_number(twh * 1000, 0), F.lit(" GWh/yr")))


def shown_duration(millis: Column) -> Column:
    s = millis / 1000
    whole = F.round(s).cast("long")
    minutes, two = F.floor(whole / 60), lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), two(minutes % 60), F.lit("m"))
    return F.when(millis.isNull(), "—").when(s < 10, F.concat(F.format_number(s, 1), F.lit(" s"))).when(s < 60, F.concat(F.format_number(s, 0), F.lit(" s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), two(whole % 60), F.lit("s"))).otherwise(hours)


def without_exponents(stored: Column, values: Column) -> Column:
    """A text whose numbers with exponents are written out: as the value they stand for, if it is known, else rounded."""
    found = F.array_distinct(F.regexp_extract_all(stored, F.lit(r"(?i)\b([0-9](?:\.[0-9]+)?e[+-]?[0-9]+)\b"), F.lit(1)))

    def plain(token: Column) -> Column:
        x = token.cast("double")
        exact = F.get(F.filter(values, lambda v: (v != 0) & (F.abs(v - x) <= 1e-5 * F.abs(v))), F.lit(0))
        return F.coalesce(F.when(exact.isNotNull(), shown_number(exact)), F.format_number(F.round(x), 0))

    return F.aggregate(found, stored, lambda done, token: F.replace(done, token, plain(token)))
