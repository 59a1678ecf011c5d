"""Filings: yearly series of reported facts, annual reports, and who a company is in the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.functions import kernels, text, url
from factweir.functions import patterns as p
from factweir.functions.figures import says
from factweir.shipping import ship

#: Annual forms, concepts of each metric in order of preference, and exchanges whose companies file.
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "40-F", "10-KT")
ORIGINAL_FORMS = ("10-K", "20-F", "40-F")
CONCEPTS = {
    "capex": (
        "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
        "PaymentsToAcquirePropertyPlantAndEquipmentAndIntangibleAssets", "PaymentsForCapitalImprovements",
    ),
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
}
US_EXCHANGES = ("NASDAQ", "NYSE", "NYSE AMERICAN", "NYSE ARCA", "AMEX", "CBOE", "BATS")

_FACTS = "struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,accn:string,form:string,filed:string>>>>>>>"
_RECENT = "struct<filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,filingDate:array<string>>>>"


def facts(documents: DataFrame) -> DataFrame:
    """documents(cik, json) of company facts to rows: cik, concept, start, end, val, accn, form, filed (dollars only)."""
    parsed = documents.select("cik", F.explode(F.from_json("json", _FACTS)["facts"]["us-gaap"]).alias("concept", "c"))
    return parsed.select("cik", "concept", F.explode(F.try_element_at("c.units", F.lit("USD"))).alias("f")).select("cik", "concept", "f.*")


def annual_series(rows: DataFrame, years: int = 4) -> DataFrame:
    """facts rows to cik, metric, concept, end, val, place: up to `years` full years, newest first.

    A year has 340 to 380 days; of several filings for one year's end the latest counts. A metric takes the
    concept that reaches furthest, the preferred one if several do.
    """
    order = [(m, i, c) for m, cs in CONCEPTS.items() for i, c in enumerate(cs)]
    known = F.create_map(*[x for m, i, c in order for x in (F.lit(c), F.struct(F.lit(m).alias("metric"), F.lit(i).alias("preference")))])
    length = F.datediff(F.to_date("end"), F.to_date("start"))
    full = rows.withColumn("k", known[F.col("concept")]).where(F.col("k").isNotNull() & F.col("form").isin(*ANNUAL_FORMS) & length.between(340, 380) & F.col("val").isNotNull())
    one = full.groupBy("cik", "k.metric", "k.preference", "concept", "end").agg(F.max_by("val", F.struct("filed", "accn")).alias("val"))
    reach = one.groupBy("cik", "metric", "concept", "preference").agg(F.max("end").alias("upto"))
    best = reach.groupBy("cik", "metric").agg(F.max_by("concept", F.struct("upto", -F.col("preference"))).alias("concept"))
    place = F.row_number().over(Window.partitionBy("cik", "metric").orderBy(F.desc("end")))
    return one.join(best, ["cik", "metric", "concept"]).withColumn("place", place).where(F.col("place") <= years).select("cik", "metric", "concept", "end", "val", "place")


def latest_annual_report(submissions: DataFrame) -> DataFrame:
    """submissions(cik, json) to cik, form, accession, document, filed: the first annual report that is listed."""
    recent = F.from_json("json", _RECENT)["filings"]["recent"]
    rows = submissions.select("cik", F.arrays_zip(*[recent[c].alias(c) for c in ("form", "accessionNumber", "primaryDocument", "filingDate")]).alias("z"))
    fits = F.filter("z", lambda x: x["form"].isin(*ORIGINAL_FORMS) & (F.coalesce(x["primaryDocument"], F.lit("")) != ""))
    first = rows.select("cik", F.get(fits, F.lit(0)).alias("r")).where("r IS NOT NULL")
    return first.select("cik", "r.form", F.replace("r.accessionNumber", F.lit("-"), F.lit("")).alias("accession"), F.col("r.primaryDocument").alias("document"), F.col("r.filingDate").alias("filed"))


def accession(link: Column) -> Column:
    """The eighteen digits of a filing's number in the path; null if there is none."""
    return F.nullif(F.replace(F.regexp_extract(url.path_of(link), p.ACCESSION, 1), F.lit("-"), F.lit("")), F.lit(""))


def is_registry_host(link: Column) -> Column:
    return url.under(url.host_of(link), F.lit("sec.gov"))


def is_annual_report(link: Column, title: Column, why: Column, origin: Column) -> Column:
    """The filing service's own, or a link with a filing's number that names the form or is its main document."""
    words = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (link, title, why)])
    named = says(words, p.FORM_WORDS) | (F.regexp_extract(url.path_of(link), "(?i)" + p.INLINE_MAIN, 1) != "")
    return F.coalesce(origin == "filing", F.lit(False)) | (accession(link).isNotNull() & named)


def one_annual_report(candidates: DataFrame) -> DataFrame:
    """candidates(run_id, seq, url, title, why, origin) with `skipped`: full-submission files, and every annual report
    but the best: the filing service's own, then the registry's, then the newest; the first among equals."""
    path = url.path_of(F.col("url"))
    main = F.regexp_extract(path, "(?i)" + p.INLINE_MAIN, 1)
    c = candidates.withColumn("full", is_registry_host(F.col("url")) & says(path, p.FULL_SUBMISSION))
    annual = ~F.col("full") & is_annual_report(*map(F.col, ("url", "title", "why", "origin")))
    order = F.struct((F.col("origin") == "filing").alias("a"), is_registry_host(F.col("url")).alias("b"), main.alias("c"), F.coalesce(accession(F.col("url")), F.lit("")).alias("d"), (-F.col("seq")).alias("e"))
    c = c.withColumns({"annual": annual, "best": F.max(F.when(annual, order)).over(Window.partitionBy("run_id")), "order": order})
    why = F.when(F.col("full"), "full submission").when(F.col("annual") & (F.col("order") != F.col("best")), "another annual report")
    return c.select(*candidates.columns, why.alias("skipped"))


def ticker_key(ticker: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(ticker, F.lit("")))), F.lit("."), F.lit("-"))


def identity(entities: DataFrame, registry: DataFrame, names: DataFrame) -> DataFrame:
    """entities(id, name, ticker, exchange) against registry(cik, ticker, title) and names(id, cik, title), the
    unambiguous matches by name: id, status, cik, title.

    confirmed: the ticker is listed under this name; mismatch: under another; not_listed: not at all, although the
    exchange's companies are; name_match: no ticker decides, but the name does; else unchecked.
    """
    # a registry has one row a ticker; of repeated ones the smallest cik counts
    listed = registry.groupBy(ticker_key(F.col("ticker")).alias("key")).agg(F.min(F.struct("cik", "title")).alias("hit")).where("key <> ''")
    e = entities.withColumn("key", ticker_key(F.col("ticker"))).join(listed, "key", "left").join(names.select("id", F.struct("cik", "title").alias("named")), "id", "left")
    same = text.core_name(F.col("hit.title")) == text.core_name(F.col("name"))
    domestic = reduce(lambda a, b: a | b, [F.startswith(F.upper(F.coalesce("exchange", F.lit(""))), F.lit(x)) for x in US_EXCHANGES])
    status = F.when(F.col("hit").isNotNull(), F.when(same, "confirmed").otherwise("mismatch")).when((F.col("key") != "") & domestic, "not_listed").when(F.col("named").isNotNull(), "name_match").otherwise("unchecked")
    e = e.withColumn("status", status)
    cik = F.when(F.col("status") == "confirmed", F.col("hit.cik")).when(F.col("status") == "name_match", F.col("named.cik"))
    title = F.when(F.col("status").isin("confirmed", "mismatch"), F.col("hit.title")).when(F.col("status") == "name_match", F.col("named.title"))
    return e.select("id", "status", cik.alias("cik"), title.alias("title"))


def duplicate_company(proposed: DataFrame, companies: DataFrame, threshold: float = 85.0, block: int = 20) -> DataFrame:
    """proposed(id, name, domain) to company_id, how: a company of the same domain, else one whose name holds the
    first `block` characters of the proposed name and is `threshold` alike; the smallest id of each kind.

    Each distinct name is compared once, however many companies bear it or proposals ask for it.
    """
    ship(proposed.sparkSession)
    a = proposed.select("id", "domain", text.dedup_name(F.col("name")).alias("core"))
    b = companies.select("company_id", F.col("domain").alias("own"), text.dedup_name(F.col("name")).alias("other"))
    first = lambda key: b.where(f"{key} <> ''").groupBy(key).agg(F.min("company_id").alias("company_id"))
    by_domain = a.where("domain <> ''").join(first("own"), F.col("domain") == F.col("own")).groupBy("id").agg(F.min("company_id").alias("company_id"), F.lit("domain").alias("how"))
    pairs = name_pairs(a.where("core <> ''").select("core").distinct(), first("other"), threshold, block)
    best = pairs.where(kernels.indel_ratio("core", "other") >= threshold).groupBy("core").agg(F.min("company_id").alias("company_id"))
    alike = a.join(best, "core").groupBy("id").agg(F.min("company_id").alias("company_id"), F.lit("name").alias("how"))
    return by_domain.unionByName(alike.join(by_domain.select("id"), "id", "left_anti"))


def name_pairs(asked: DataFrame, names: DataFrame, threshold: float = 85.0, block: int = 20) -> DataFrame:
    """asked(core) with each row of names(other, ...) that holds its first `block` characters, less pairs whose lengths
    forbid the threshold.

    A start shorter than `block` is the whole name asked for, and a name that holds it is `threshold` alike only if it
    isn't much longer; so each name is joined by its substrings of `block` characters and its few longest ones.
    """
    n = F.length("other")
    longest = F.least(n, F.lit(block))
    least = F.least(F.greatest(F.floor(n * threshold / (200 - threshold)).cast("int"), F.lit(1)), longest)
    parts = F.flatten(F.transform(F.sequence(least, longest), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("other"), i, k))))
    held = names.where("other <> ''").select("*", F.explode(F.array_distinct(parts)).alias("head"))
    return asked.withColumn("head", F.left("core", F.lit(block))).join(held, "head").drop("head")
