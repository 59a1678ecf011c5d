"""Rules and views of a running service: who is asked next, what waits, what is due, reports as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.functions import text, url
from factweir.operators import records, traffic
from factweir.operators.runs import current

#: Triggers of runs that nobody asked for by hand.
AUTOMATIC = ("energy_retry", "auto_sweep", "sweep")
#: Links that a run's pages may add, and classes of agents in a report.
DISCOVERED_MOST, AGENT_CLASSES = 4, ("human", "bot", "monitor")
#: Bytes of an id and its blank in a list, bytes of lists that a task should return, and tasks at most.
ID_BYTES, TASK_BYTES, TASKS_MOST = 8, 64 << 20, 50_000


def new_candidates(found: DataFrame, known: DataFrame, most: int = DISCOVERED_MOST) -> DataFrame:
    """found(run_id, seq, url) that aren't in known(run_id, url) by normal url: run_id, place, url.

    Of one url the first counts; a run takes the first `most`. Runs may have any number of finds: repeats are
    combined before they are ordered.
    """
    f = found.where("url IS NOT NULL").withColumn("_normal", url.normal_url(F.col("url")))
    k = known.where("url IS NOT NULL").select("run_id", url.normal_url(F.col("url")).alias("_normal")).distinct()
    first = f.groupBy("run_id", "_normal").agg(F.min(F.struct("seq", "url")).alias("f")).join(k, ["run_id", "_normal"], "left_anti")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("f"))
    return first.select("run_id", place.alias("place"), F.col("f.url").alias("url")).where(F.col("place") <= most)


def recent_sources(sources: DataFrame, runs: DataFrame, since: Column, without: str = "edgar") -> DataFrame:
    """Sources of runs that ended since a moment, but for those of one origin; the window is read off the runs."""
    recent = runs.where(F.col("finished_at") >= since).select("run_id", "company_id")
    return sources.where(F.coalesce(F.col("origin") != without, F.lit(True))).join(recent, "run_id")


def run_links(history: DataFrame, companies: DataFrame) -> DataFrame:
    """history(company_id, run_id, ordinal, is_current) to run_id and link: the company's page for its current run,
    else the run's own by ordinal."""
    page = F.concat(F.lit("/companies/"), text.slug(F.col("name")))
    h = history.join(companies.select("company_id", "name"), "company_id")
    return h.select("run_id", F.when(F.col("is_current"), page).otherwise(F.concat(page, F.lit("/runs/"), F.col("ordinal").cast("string"))).alias("link"))


def run_requests(asked: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """asked(request_id, company_id, run_trigger) to request_id, outcome and run_id: `created` where the company has no
    active run, `run now` where a request by hand pulls a scheduled one forward, else `exists`.

    runs(run_id, company_id, status, next_attempt). Of several active runs the latest counts; of several requests
    for a company the first is created, the others then find it. request_id is unique.
    """
    active = runs.where(F.col("status").isin("queued", "running")).groupBy("company_id").agg(F.max(F.struct("run_id", "status", "next_attempt")).alias("a"))
    a = asked.join(active, "company_id", "left")
    waits = records.is_scheduled(F.col("a.status"), F.col("a.next_attempt"), now) & ~F.coalesce(F.col("run_trigger").isin(*AUTOMATIC), F.lit(False))
    # what a first request by hand pulled forward no longer waits, what it created exists
    free = F.col("a").isNull()
    turn = F.row_number().over(Window.partitionBy("company_id", F.coalesce(waits | free, F.lit(False))).orderBy("request_id"))
    first = turn == 1
    return a.select("request_id", F.when(free & first, "created").when(waits & first, "run now").otherwise("exists").alias("outcome"), F.col("a.run_id").alias("run_id"))


def is_due(now: Column, last: Column, hour: int, zone: str = "UTC") -> Column:
    """Whether a daily job runs now: its hour has come in its zone, and it hasn't run on this day there."""
    local = F.from_utc_timestamp(now.cast("timestamp"), zone)
    done = F.to_date(F.from_utc_timestamp(last.cast("timestamp"), zone))
    return (F.hour(local) >= hour) & (done.isNull() | (done < F.to_date(local)))


def backoff_seconds(attempt: Column, retry_after: Column, draw: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before a try (from 1): what the server asked for, else between half and all of base ** attempt, by a
    draw from 0 to 1; at most `most`. A negative wish is none."""
    top = F.least(F.lit(most), F.pow(F.lit(base), attempt))
    return F.when(retry_after.isNotNull(), F.least(F.lit(most), F.greatest(retry_after, F.lit(0.0)))).otherwise(top / 2 + draw * top / 2)


def capped_body(body: Column, content_type: Column, most: int, html_most: int | None = None, pdf_most: int | None = None) -> Column:
    """struct(body, truncated): the first bytes of a body, as many as its kind may have; PDF by type or first bytes."""
    kind = F.coalesce(F.lower(content_type) == "application/pdf", F.lit(False)) | (F.substring(body, 1, 5) == F.lit(b"%PDF-"))
    own = F.when(kind, F.lit(pdf_most or most)).otherwise(F.lit(html_most or most))
    cap = F.least(F.lit(most), own)
    return F.struct(F.substring(body, F.lit(1), cap).alias("body"), (F.octet_length(body) > cap).alias("truncated"))


def canonical_json(values: Column) -> Column:
    """A map as JSON with its keys in order, the same however it was built."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def bundle_hash(values: Column) -> Column:
    """SHA-256 of the canonical JSON of a map."""
    return F.sha2(canonical_json(values), 256)


def full_dossier(companies: DataFrame, runs: DataFrame, replayed: DataFrame, scores: DataFrame, cited: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """company_id, name, current_run, categories, sources, rejected_sources, last_failed and active_run, a row for each company.

    scores(run_id, category, ordinal, score); cited(run_id, category, pos, evidence_id); evidence(evidence_id, run_id,
    source_id, quote, verified); sources(run_id, source_id, url, status, is_primary). A category lists its verified
    evidence in the order it is cited, each quote (in normal form) and site once; sources that were read come primary ones
    first. last_failed only counts after the current run. What meets in one row is what one run's page shows.
    """
    now = current(replayed).withColumnRenamed("current_run", "run_id")
    of = now.select("run_id")
    listed = _cited(cited.join(of, "run_id", "left_semi"), evidence.join(of, "run_id", "left_semi"), sources, "run_id", "category")
    cats = scores.join(of, "run_id", "left_semi").join(listed, ["run_id", "category"], "left")
    nothing = F.array().cast("array<struct<pos:int,evidence_id:bigint,quote:string,url:string>>")
    item = F.struct("ordinal", "category", "score", F.coalesce("evidence", nothing).alias("evidence"))
    categories = cats.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("categories"))
    c = _states(companies, runs, now).join(categories, "run_id", "left").join(_read(sources.join(of, "run_id", "left_semi"), "run_id"), "run_id", "left")
    return c.select("company_id", "name", F.col("run_id").alias("current_run"), "categories", "sources", F.coalesce("rejected_sources", F.lit(0)).alias("rejected_sources"), "last_failed", "active_run")


def _cited(cited: DataFrame, evidence: DataFrame, sources: DataFrame, *by: str, shown: tuple[str, ...] = ("quote", "url")) -> DataFrame:
    """`by` and evidence: what is verified, in the order it is cited, each quote (in normal form) and site once.

    Quotes are told apart by the SHA-256 of their normal form; they are only shuffled themselves if they are shown.
    """
    digest = F.sha2(text.normal_text(F.col("quote")), 256).alias("_quote")
    linked = evidence.where("verified").select("evidence_id", "source_id", "quote", digest).join(sources.select("source_id", "url"), "source_id", "left")
    # the source of a piece of evidence has one row, so evidence keeps its own rows
    first = cited.join(linked, "evidence_id").groupBy(*by, "_quote", url.host_of(F.col("url")).alias("_site")).agg(F.min(F.struct("pos", "evidence_id", *shown)).alias("e"))
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("evidence"))


def _read(sources: DataFrame, by: str) -> DataFrame:
    """`by`, the sources that were read, primary ones first, and rejected_sources."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    read = F.when(ok, F.struct((~F.coalesce("is_primary", F.lit(False))).alias("later"), "source_id", "url"))
    got = sources.groupBy(by).agg(F.array_sort(F.collect_list(read)).alias("sources"), F.count_if(~ok).alias("rejected_sources"))
    return got.withColumn("sources", F.transform("sources", lambda s: s.dropFields("later")))


def _states(companies: DataFrame, runs: DataFrame, now: DataFrame) -> DataFrame:
    """company_id, name, run_id, last_failed and active_run; a failure only counts after the current run."""
    state = runs.groupBy("company_id").agg(F.max(F.when(F.col("status") == "failed", F.col("run_id"))).alias("failed"), F.max(F.when(F.col("status").isin("queued", "running"), F.col("run_id"))).alias("active_run"))
    late = F.when(F.col("run_id").isNull() | (F.col("failed") > F.col("run_id")), F.col("failed"))
    return companies.select("company_id", "name").join(now, "company_id", "left").join(state, "company_id", "left").select("company_id", "name", "run_id", late.alias("last_failed"), "active_run")


def shared_dossier(companies: DataFrame, runs: DataFrame, replayed: DataFrame, scores: DataFrame, read_by: Column, cited: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """`full_dossier` where many runs share what they read, its lists as text: ids of evidence and sources.

    read_by: which of a few sets the run in `run_id` read; cited(set_id, ordinal, pos, evidence_id), of the categories with
    this ordinal; evidence(evidence_id, source_id, quote, verified); sources(set_id, source_id, url, status, is_primary).
    Lists are made once for each set and meet the companies last, so that neither they nor texts are shuffled a run.
    Companies with the same lists are brought together before that: a file of the result then holds few different lists,
    of which Parquet keeps one copy each. Counts companies and sources at once for that.
    """
    now = current(replayed).withColumnRenamed("current_run", "run_id").where("company_id IS NOT NULL AND run_id IS NOT NULL")
    ids = lambda c, name: F.array_join(F.transform(c, lambda x: x[name].cast("string")), " ")
    claims = _cited(cited, evidence, sources, "set_id", "ordinal", shown=()).select("set_id", F.struct(F.col("ordinal").cast("long").alias("o"), ids("evidence", "evidence_id").alias("t")).alias("e"))
    claims = claims.groupBy("set_id").agg(F.map_from_entries(F.collect_list("e")).alias("claims"))
    sets = _read(sources.where("set_id IS NOT NULL"), "set_id").withColumn("sources", ids("sources", "source_id")).join(claims, "set_id", "full")
    cats = scores.join(now.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "category"))).alias("cats"))
    longest = sources.where("set_id IS NOT NULL").groupBy("set_id").count().agg(F.max("count")).first()[0] or 0
    tasks = min(TASKS_MOST, 1 + companies.count() * longest * ID_BYTES // TASK_BYTES)
    alike = _states(companies, runs, now).join(cats, "run_id", "left").withColumn("set_id", read_by).repartitionByRange(tasks, "set_id", F.xxhash64("cats"), "company_id")
    c = alike.join(F.broadcast(sets), "set_id", "left")
    shown = F.array_join(F.transform("cats", lambda k: F.concat(k["category"], F.lit(":"), F.coalesce(F.try_element_at("claims", k["ordinal"].cast("long")), F.lit("")))), "; ")
    return c.select("company_id", "name", F.col("run_id").alias("current_run"), shown.alias("categories"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("rejected_sources", F.lit(0)).alias("rejected_sources"), "last_failed", "active_run")


def traffic_report(rows: DataFrame, start: Column, days: int, classes: tuple[str, ...] = ("human",), top: int = 10) -> DataFrame:
    """One row: series (newest first), avg7, pages, refs, utm, countries, country_unknown, share and total_views.

    rows: rollup rows of the days (see `traffic.daily`). What is listed is bounded by `days` and `top`.
    """
    series = traffic.series(rows, start, days, classes)
    last = F.max_by(F.round(F.col("sum7") / F.greatest(F.col("n7"), F.lit(1)), 1), "day")
    s = series.agg(F.sort_array(F.collect_list(F.struct("day", "visitors", "views", "pct")), asc=False).alias("series"), last.alias("avg7"))
    keys = traffic.top_keys(rows, classes, top)
    named = lambda dim: F.array_sort(F.collect_list(F.when(F.col("dim") == dim, F.struct("place", "key", "views"))))
    plain = lambda c: F.transform(c, lambda k: k.dropFields("place"))
    k = keys.agg(*[plain(named(d)).alias(n) for d, n in (("path", "pages"), ("ref", "refs"), ("utm_source", "utm"), ("country", "countries"))])
    unknown = rows.where((F.col("dim") == "country") & (F.col("key") == "??") & F.col("ua_class").isin(*classes)).agg(F.coalesce(F.sum("views"), F.lit(0)).alias("country_unknown"))
    total = rows.where("dim = 'total'").groupBy("ua_class").agg(F.sum("views").alias("views"))
    t = total.agg(F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"), F.map_from_entries(F.collect_list(F.struct("ua_class", "views"))).alias("by_class"))
    part = lambda c: F.when(F.col("total_views") > 0, F.round(100 * F.coalesce(F.try_element_at("by_class", F.lit(c)), F.lit(0)) / F.col("total_views"), 1)).otherwise(0.0)
    share = F.create_map(*[x for c in AGENT_CLASSES for x in (F.lit(c), part(c))])
    return s.join(F.broadcast(k)).join(F.broadcast(unknown)).join(F.broadcast(t)).select("*", share.alias("share")).drop("by_class")  # one row each
