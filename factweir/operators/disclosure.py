"""Which unreadable sources are a company's own energy disclosures, and what that means for its run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweir.functions import patterns as p
from factweir.functions import url
from factweir.functions.figures import says

#: HTTP answers of a source that exists but can't be read, and those that may go away.
UNREADABLE_HTTP = (401, 403, 406, 429, 451, 500, 502, 503, 504)
TRANSIENT_HTTP = (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)


def publisher(link: Column, domain: Column) -> Column:
    """registry, own, unknown-domain (the company's domain isn't known), or null for a third party."""
    host = url.host_of(link)
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^https?://", ""), r"^www\.|/.*$", "")
    registry = F.lit(False)
    for name in p.REGISTRIES:
        registry = registry | url.under(host, F.lit(name))
    return F.when(registry, "registry").when(plain == "", "unknown-domain").when(url.under(host, plain), "own")


def disclosure(link: Column, title: Column, status: Column, covers: Column, why: Column, domain: Column) -> Column:
    """Why a source counts as the company's energy disclosure; null if it doesn't."""
    by, path = publisher(link, domain), F.coalesce(F.nullif(url.path_of(link), F.lit("")), F.lit("/"))
    energy = F.coalesce(F.array_contains(covers, "energy"), F.lit(False))
    host = url.host_of(link)
    listing = says(path, p.LISTING_PATH) | ((by == "own") & says(path, p.INVESTOR_ROOT) & (host.startswith("ir.") | host.startswith("investor")))
    pdf = F.endswith(F.lower(path), F.lit(".pdf"))
    page = says(path, p.REPORT_PATH) | (pdf & says(path, p.REPORT_PDF))
    claim = says(F.concat_ws(" ", F.coalesce(why, F.lit("")), F.coalesce(title, F.lit(""))), p.CONSUMPTION_CLAIM)
    signal = says(F.concat_ws(" ", link, F.coalesce(title, F.lit(""))), p.DISCLOSURE_SIGNAL)
    kind = (
        F.when(listing, F.when(energy & claim, "listing with a consumption claim"))
        .when(page, F.when(pdf, "report document").otherwise("report page"))
        .when(signal, "named in link or title")
        .when(~F.coalesce(status == "thin", F.lit(False)) & energy & says(why, p.DISCLOSURE_SIGNAL), "named in the claim")
    )
    return F.when(by.isNotNull() & kind.isNotNull(), F.concat(by, F.lit(": "), kind))


def unreadable(status: Column, http: Column, reason: Column) -> Column:
    """The source is there but its text couldn't be had, as opposed to a dead link or a soft 404."""
    said = F.lower(F.coalesce(reason, F.lit("")))
    slow = said.contains("timeout") | said.contains("timed out") | said.contains("read")
    dead = F.coalesce(http.isin(*UNREADABLE_HTTP), F.lit(False)) | (http.isNull() & slow)
    return status.isin("error", "thin") | ((status == "dead") & dead)


def transient_reason(status: Column, http: Column, reason: Column, outcome: Column, note: Column) -> Column:
    """Why a dead source might read fine later; null if it is a real answer."""
    said = F.lower(F.coalesce(reason, F.lit("")))
    slow = http.isNull() & (said.contains("timeout") | said.contains("timed out"))
    down = outcome.isin("rate_limited", "capped") | ((outcome == "unavailable") & F.coalesce(note, F.lit("")).contains("unavailable ("))
    refused = F.coalesce(http.isin(*UNREADABLE_HTTP), F.lit(False)) & F.coalesce(down, F.lit(False))
    why = F.when(http.isin(*TRANSIENT_HTTP), F.concat(F.lit("HTTP "), http.cast("string"))).when(slow, "timeout").when(refused, F.concat(F.lit("HTTP "), http.cast("string"), F.lit(", archive "), outcome))
    return F.when(status == "dead", why)


def unreadable_disclosures(sources: DataFrame, candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """Unreadable energy disclosures of each run: run_id, source_id, counted_as.

    sources(run_id, source_id, url, title, status, http_status, reject_reason, origin), candidates(run_id, url,
    title, covers, why), companies(run_id, domain). Sources that came from the filing service don't count.
    """
    failed = sources.where((F.col("origin") != "edgar") & unreadable(F.col("status"), F.col("http_status"), F.col("reject_reason")))
    known = candidates.groupBy("run_id", "url").agg(F.max_by(F.struct("title", "covers", "why"), "candidate_id").alias("c"))
    rows = failed.join(known, ["run_id", "url"], "left").join(companies.select("run_id", "domain"), "run_id", "left")
    why = disclosure(F.col("url"), F.coalesce("title", "c.title"), F.col("status"), F.col("c.covers"), F.col("c.why"), F.col("domain"))
    return rows.select("run_id", "source_id", why.alias("counted_as")).where("counted_as IS NOT NULL")


def withhold_unreadable(runs: DataFrame, disclosures: DataFrame) -> DataFrame:
    """runs with ranked, basis and reason overridden where energy has no score and a disclosure couldn't be read."""
    first = disclosures.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_unreadable"), F.min_by("counted_as", "source_id").alias("counted_as"))
    hit = F.col("n_unreadable").isNotNull() & F.col("energy_score").isNull()
    reason = F.concat(F.lit("energy source found but couldn't be read ("), F.col("n_unreadable").cast("string"), F.lit(": "), F.col("counted_as"), F.lit(")"))
    joined = runs.join(first, "run_id", "left")
    return joined.select(
        "run_id",
        F.when(hit, False).otherwise(F.col("ranked")).alias("ranked"),
        F.when(hit, "energy_unreadable").otherwise(F.col("basis")).alias("basis"),
        F.when(hit, F.left(reason, F.lit(260))).otherwise(F.col("reason")).alias("reason"),
    )


def registry_needed(sources: DataFrame, candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """run_id and `needed`: no source on energy was read, or an own disclosure failed without being gone."""
    known = candidates.groupBy("run_id", "url").agg(F.max_by(F.struct("title", "covers", "why"), "candidate_id").alias("c"))
    rows = sources.join(known, ["run_id", "url"], "left").join(companies.select("run_id", "domain"), "run_id", "left")
    energy = F.coalesce(F.array_contains("c.covers", "energy"), F.lit(False))
    read = (F.col("status") == "ok") & energy & (F.col("origin") != "edgar")
    gone = F.coalesce(F.col("http_status").isin(404, 410), F.lit(False))
    why = disclosure(F.col("url"), F.coalesce("title", "c.title"), F.col("status"), F.col("c.covers"), F.col("c.why"), F.col("domain"))
    lost = F.col("status").isin("dead", "error", "thin") & ~gone & why.isNotNull()
    return rows.groupBy("run_id").agg((~F.bool_or(read) | F.bool_or(lost)).alias("needed"))


def candidate_priority(link: Column, title: Column, origin: Column, covers: Column) -> Column:
    """Research picks before citations; on energy, compact data before full reports."""
    both = F.concat_ws(" ", F.coalesce(link, F.lit("")), F.coalesce(title, F.lit("")))
    energy = F.coalesce(F.array_contains(covers, "energy"), F.lit(False)) | says(both, p.ENERGY_HINT)
    size = F.when(energy & says(both, p.COMPACT_DATA), 3).when(energy & says(link, p.BULKY_REPORT), -1).otherwise(0)
    return F.when(origin == "research", 2).otherwise(0) + size
