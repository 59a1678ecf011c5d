"""Queries over disclosures, filings, model answers, evidence and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweir.functions import figures as fg
from factweir.functions import patterns as p
from factweir.functions import url
from factweir.operators import disclosure as d
from factweir.operators import envelopes as env
from factweir.operators import filings as fl
from factweir.operators import publication as pub
from factweir.operators import records as rec
from factweir.operators import runs as r
from factweir.operators import scoring as s
from factweir.plans.query import Queries
from factweir.plans.run_queries import RUNS
from factweir.sources.derive import NOW, derived, with_sql
from factweir.tables import table

Q = Queries()

_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '')"
_PATH = "coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/')"
DISCLOSED = with_sql("links") + f""", h AS (SELECT *, {_HOST} AS host, {_PATH} AS path, list_contains(string_split(covers, ','), 'energy') AS en FROM links),
b AS (SELECT *, CASE WHEN host IN ('cdp.net', 'responsibilityreports.com') OR ends_with(host, '.cdp.net') THEN 'registry' WHEN domain IS NULL THEN 'unknown-domain'
    WHEN host = 'acme.com' OR ends_with(host, '.acme.com') THEN 'own' END AS publisher FROM h),
k AS (SELECT *, CASE WHEN regexp_matches(path, '(?i){p.LISTING_PATH}') OR (publisher = 'own' AND regexp_matches(path, '(?i){p.INVESTOR_ROOT}') AND (starts_with(host, 'ir.') OR starts_with(host, 'investor')))
      THEN CASE WHEN en AND regexp_matches(coalesce(why, '') || ' ' || coalesce(title, ''), '(?i){p.CONSUMPTION_CLAIM}') THEN 'listing with a consumption claim' END
    WHEN regexp_matches(path, '(?i){p.REPORT_PATH}') THEN 'report page' WHEN ends_with(path, '.pdf') AND regexp_matches(path, '(?i){p.REPORT_PDF}') THEN 'report document'
    WHEN regexp_matches(url || ' ' || coalesce(title, ''), '(?i){p.DISCLOSURE_SIGNAL}') THEN 'named in link or title'
    WHEN status <> 'thin' AND en AND regexp_matches(coalesce(why, ''), '(?i){p.DISCLOSURE_SIGNAL}') THEN 'named in the claim' END AS kind FROM b),
dl AS (SELECT *, publisher || ': ' || kind AS counted_as,
    status IN ('error', 'thin') OR (status = 'dead' AND (coalesce(http_status IN {d.UNREADABLE_HTTP}, false) OR (http_status IS NULL AND regexp_matches(lower(coalesce(reject_reason, '')), 'timeout|timed out|read')))) AS lost FROM k)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "links").withColumn("covers", F.split("covers", ","))


def _disclosed(links: DataFrame) -> F.Column:
    return d.disclosure(*[F.col(c) for c in ("url", "title", "status", "covers", "why", "domain")])


@Q.add("disclosure_classes", DISCLOSED + "SELECT source_id, coalesce(publisher, '') AS publisher, coalesce(counted_as, '') AS counted_as FROM dl")
def disclosure_classes(spark, sf_dir):
    links = _links(spark, sf_dir)
    empty = F.lit("")
    return links.select("source_id", F.coalesce(d.publisher(F.col("url"), F.col("domain")), empty).alias("publisher"), F.coalesce(_disclosed(links), empty).alias("counted_as"))


@Q.add("source_readability", DISCLOSED + f"""SELECT source_id, lost AS unreadable, coalesce(CASE WHEN status = 'dead' THEN CASE WHEN http_status IN {d.TRANSIENT_HTTP} THEN 'HTTP ' || http_status WHEN http_status IS NULL AND regexp_matches(lower(coalesce(reject_reason, '')), 'timeout|timed out') THEN 'timeout'
  WHEN http_status IN {d.UNREADABLE_HTTP} AND (outcome IN ('rate_limited', 'capped') OR (outcome = 'unavailable' AND contains(note, 'unavailable ('))) THEN 'HTTP ' || http_status || ', archive ' || outcome END END, '') AS transient FROM dl""")
def source_readability(spark, sf_dir):
    c = [F.col(x) for x in ("status", "http_status", "reject_reason")]
    return _links(spark, sf_dir).select("source_id", d.unreadable(*c).alias("unreadable"), F.coalesce(d.transient_reason(*c, F.col("outcome"), F.col("note")), F.lit("")).alias("transient"))


def _run_domain(links: DataFrame) -> DataFrame:
    return links.groupBy("run_id").agg(F.max("domain").alias("domain"))


@Q.add("unreadable_disclosures", DISCLOSED + "SELECT run_id, source_id, counted_as FROM dl WHERE origin <> 'edgar' AND lost AND counted_as IS NOT NULL")
def unreadable_disclosures(spark, sf_dir):
    links = _links(spark, sf_dir)
    # one candidate for each source: urls repeat, so each source names its own
    named = links.withColumn("url", F.concat("url", F.lit("#"), F.col("source_id").cast("string")))
    return d.unreadable_disclosures(named.drop("covers", "why", "candidate_id", "domain"), named.select("run_id", "url", "title", "covers", "why", "candidate_id"), _run_domain(links))


@Q.add("energy_unreadable_runs", DISCLOSED + """, u AS (SELECT run_id, count(*) AS n, arg_min(counted_as, source_id) AS c FROM dl WHERE origin <> 'edgar' AND lost AND counted_as IS NOT NULL GROUP BY run_id),
rr AS (SELECT DISTINCT run_id, CASE WHEN run_id % 3 = 0 THEN 1.0 END AS energy_score FROM links)
SELECT run_id, CASE WHEN n IS NOT NULL AND energy_score IS NULL THEN false ELSE run_id % 2 = 0 END AS ranked, CASE WHEN n IS NOT NULL AND energy_score IS NULL THEN 'energy_unreadable' ELSE 'standard' END AS basis,
  CASE WHEN n IS NOT NULL AND energy_score IS NULL THEN left('energy source found but couldn''t be read (' || n || ': ' || c || ')', 260) ELSE '' END AS reason FROM rr LEFT JOIN u USING (run_id)""")
def energy_unreadable_runs(spark, sf_dir):
    runs = _links(spark, sf_dir).select("run_id").distinct()
    runs = runs.select("run_id", F.when(F.col("run_id") % 3 == 0, 1.0).alias("energy_score"), (F.col("run_id") % 2 == 0).alias("ranked"), F.lit("standard").alias("basis"), F.lit("").alias("reason"))
    return d.withhold_unreadable(runs, unreadable_disclosures(spark, sf_dir))


@Q.add("registry_needed", DISCLOSED + """SELECT run_id, NOT bool_or(status = 'ok' AND en AND origin <> 'edgar') OR bool_or(status IN ('dead', 'error', 'thin') AND coalesce(http_status NOT IN (404, 410), true) AND counted_as IS NOT NULL) AS needed FROM dl GROUP BY run_id""")
def registry_needed(spark, sf_dir):
    links = _links(spark, sf_dir)
    named = links.withColumn("url", F.concat("url", F.lit("#"), F.col("source_id").cast("string")))
    return d.registry_needed(named.drop("covers", "why", "candidate_id", "domain"), named.select("run_id", "url", "title", "covers", "why", "candidate_id"), _run_domain(links))


@Q.add("candidate_priority", with_sql("links") + f""", c AS (SELECT *, url || ' ' || coalesce(title, '') AS t, list_contains(string_split(covers, ','), 'energy') AS en FROM links),
pr AS (SELECT *, CASE WHEN origin = 'research' THEN 2 ELSE 0 END + CASE WHEN (en OR regexp_matches(t, '(?i){p.ENERGY_HINT}')) AND regexp_matches(t, '(?i){p.COMPACT_DATA}') THEN 3
  WHEN (en OR regexp_matches(t, '(?i){p.ENERGY_HINT}')) AND regexp_matches(url, '(?i){p.BULKY_REPORT}') THEN -1 ELSE 0 END AS priority FROM c)
SELECT run_id, source_id, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, source_id) AS place FROM pr) WHERE place <= 12""")
def candidate_priority(spark, sf_dir):
    c = _links(spark, sf_dir).withColumn("priority", d.candidate_priority(*[F.col(x) for x in ("url", "title", "origin", "covers")]))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("priority"), "source_id"))
    return c.withColumn("place", place).where("place <= 12").select("run_id", "source_id", "priority", "place")


_CONCEPTS = ", ".join(f"('{m}', {i}, '{c}')" for m, cs in fl.CONCEPTS.items() for i, c in enumerate(cs))


@Q.add("annual_facts", with_sql("fact_rows") + f""", k(metric, preference, concept) AS (VALUES {_CONCEPTS}),
f AS (SELECT cik, metric, preference, concept, end_day, arg_max(val, filed || accn) AS val FROM fact_rows JOIN k USING (concept)
  WHERE form IN {fl.ANNUAL_FORMS} AND date_diff('day', cast(start_day AS date), cast(end_day AS date)) BETWEEN 340 AND 380 GROUP BY ALL),
b AS (SELECT cik, metric, arg_max(concept, u || (9 - preference)) AS concept FROM (SELECT cik, metric, preference, concept, max(end_day) AS u FROM f GROUP BY ALL) GROUP BY cik, metric)
SELECT cik, metric, concept, "end", cast(val AS bigint) AS val, place FROM (SELECT cik, metric, concept, end_day AS "end", val, row_number() OVER (PARTITION BY cik, metric ORDER BY end_day DESC) AS place FROM f JOIN b USING (cik, metric, concept)) WHERE place <= 4""")
def annual_facts(spark, sf_dir):
    rows = derived(spark, sf_dir, "fact_rows")
    fact = F.struct(F.col("start_day").alias("start"), F.col("end_day").alias("end"), "val", "accn", "form", "filed")
    units = rows.groupBy("cik", "concept").agg(F.collect_list(fact).alias("USD")).select("cik", F.struct("concept", F.struct(F.struct("USD").alias("units")).alias("v")).alias("c"))
    docs = units.groupBy("cik").agg(F.map_from_entries(F.collect_list("c")).alias("us-gaap")).select("cik", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("json"))
    return fl.annual_series(fl.facts(docs)).withColumn("val", F.col("val").cast("long"))


@Q.add("annual_reports", with_sql("fact_rows") + """SELECT cik, form, accession, document, filed FROM (SELECT cik, form, replace(accn, '-', '') AS accession, 'd' || right(accn, 3) || '.htm' AS document, filed,
  row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accn DESC) AS n FROM fact_rows WHERE form IN ('10-K', '20-F') AND right(accn, 1) <> '0') WHERE n = 1""")
def annual_reports(spark, sf_dir):
    document = F.when(F.right("accn", F.lit(1)) == "0", "").otherwise(F.concat(F.lit("d"), F.right("accn", F.lit(3)), F.lit(".htm")))
    rows = derived(spark, sf_dir, "fact_rows").withColumn("document", document)
    listed = rows.groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("filed", "accn", "form", "document")), asc=False).alias("x"))
    column = lambda c: F.transform("x", lambda v: v[c])
    recent = F.struct(column("form").alias("form"), column("accn").alias("accessionNumber"), column("document").alias("primaryDocument"), column("filed").alias("filingDate"))
    return fl.latest_annual_report(listed.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json")))


@Q.add("filing_links", with_sql("fact_rows") + f""", c AS (SELECT cik AS run_id, row_number() OVER () AS x, accn, form, right(accn, 2) AS e FROM fact_rows WHERE right(accn, 1) IN ('0', '1', '2', '3')),
u AS (SELECT run_id, accn, CASE WHEN right(accn, 1) = '0' THEN 'https://www.sec.gov/Archives/edgar/data/1/' || replace(left(accn, 20), '-', '') || '/x-20231231.htm' WHEN right(accn, 1) = '1' THEN 'https://www.sec.gov/Archives/edgar/data/12/' || left(accn, 20) || '.txt'
  WHEN right(accn, 1) = '2' THEN 'https://files.example.com/' || left(accn, 20) || '/report' ELSE 'https://example.com/10-k' END AS url, cast(right(accn, 7) AS bigint) AS seq, CASE WHEN right(accn, 2) = '42' THEN 'filing' ELSE 'research' END AS origin FROM c),
a AS (SELECT *, regexp_matches(url, 'edgar/data/[0-9]+/[0-9]{{10}}-[0-9]{{2}}-[0-9]{{6}}[.]txt$') AS fu, origin = 'filing' OR right(accn, 1) IN ('0', '2') AS an FROM u),
g AS (SELECT *, CASE WHEN an AND NOT fu THEN row_number() OVER (PARTITION BY run_id, an AND NOT fu ORDER BY origin = 'filing' DESC, contains(url, 'sec.gov') DESC, right(accn, 1) = '0' DESC, replace(left(accn, 20), '-', '') DESC, seq) END AS n FROM a)
SELECT run_id, seq, CASE WHEN fu THEN 'full submission' WHEN n > 1 THEN 'another annual report' ELSE '' END AS skipped FROM g""")
def filing_links(spark, sf_dir):
    f = derived(spark, sf_dir, "fact_rows").where(F.right("accn", F.lit(1)).isin("0", "1", "2", "3"))
    last, head = F.right("accn", F.lit(1)), F.left("accn", F.lit(20))
    link = F.when(last == "0", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/1/"), F.replace(head, F.lit("-"), F.lit("")), F.lit("/x-20231231.htm"))).when(last == "1", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/12/"), head, F.lit(".txt"))).when(last == "2", F.concat(F.lit("https://files.example.com/"), head, F.lit("/report"))).otherwise("https://example.com/10-k")
    c = f.select(F.col("cik").alias("run_id"), F.right("accn", F.lit(7)).cast("long").alias("seq"), link.alias("url"), F.lit(None).cast("string").alias("title"), F.when(last == "2", "annual report").alias("why"), F.when(F.right("accn", F.lit(2)) == "42", "filing").otherwise("research").alias("origin"))
    return fl.one_annual_report(c).select("run_id", "seq", F.coalesce("skipped", F.lit("")).alias("skipped"))


@Q.add("identity_checks", """WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Supplier#' || lpad(cast(c_custkey % 90 + 1 AS varchar), 9, '0') ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 's.' || (c_custkey % 90 + 1) END AS ticker,
  CASE WHEN c_custkey % 5 = 0 THEN 'nyse arca' ELSE 'XETRA' END AS exchange FROM customer),
l AS (SELECT s_suppkey AS cik, 'S-' || s_suppkey AS ticker, s_name AS title FROM supplier WHERE s_suppkey % 2 = 0),
j AS (SELECT e.*, l.cik AS hc, l.title AS ht, nc, nt FROM e LEFT JOIN l ON upper(replace(e.ticker, '.', '-')) = l.ticker LEFT JOIN (SELECT s_name AS nt, s_suppkey AS nc FROM supplier) n ON n.nt = e.name),
st AS (SELECT *, CASE WHEN hc IS NOT NULL THEN CASE WHEN ht = name THEN 'confirmed' ELSE 'mismatch' END WHEN ticker IS NOT NULL AND starts_with(upper(exchange), 'NYSE') THEN 'not_listed' WHEN nc IS NOT NULL THEN 'name_match' ELSE 'unchecked' END AS status FROM j)
SELECT id, status, coalesce(CASE status WHEN 'confirmed' THEN hc WHEN 'name_match' THEN nc END, -1) AS cik, coalesce(CASE WHEN status IN ('confirmed', 'mismatch') THEN ht WHEN status = 'name_match' THEN nt END, '') AS title FROM st""")
def identity_checks(spark, sf_dir):
    i = F.col("c_custkey")
    name = F.when(i % 4 == 0, F.concat(F.lit("Supplier#"), F.lpad((i % 90 + 1).cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    e = table(spark, sf_dir, "customer").select(i.alias("id"), name.alias("name"), F.when(i % 3 != 0, F.concat(F.lit("s."), (i % 90 + 1).cast("string"))).alias("ticker"), F.when(i % 5 == 0, "nyse arca").otherwise("XETRA").alias("exchange"))
    s_ = table(spark, sf_dir, "supplier")
    registry = s_.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("cik"), F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title"))
    names = e.join(s_, e["name"] == s_["s_name"]).select("id", F.col("s_suppkey").alias("cik"), F.col("s_name").alias("title"))
    return fl.identity(e, registry, names).select("id", "status", F.coalesce("cik", F.lit(-1)).alias("cik"), F.coalesce("title", F.lit("")).alias("title"))


@Q.add("duplicate_companies")
def duplicate_companies(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("d"), F.col("p_partkey").cast("string"))).alias("domain"))
    asked = c.select(F.col("company_id").alias("id"), F.concat("name", F.lit("s")).alias("name"), "domain")
    return fl.duplicate_company(asked, c)


ANSWERS = with_sql("answer_items") + f""", n AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos) - 1 AS pos, source_id, coalesce(nullif(trim(metric_key), ''), '') AS mk, try_cast(value AS double) AS v, nullif(trim(unit), '') AS u, quote AS q, category, score, ref FROM answer_items WHERE NOT broken),
a AS (SELECT *, CASE mk WHEN 'energy_consumed' THEN 'energy_consumption' ELSE mk END AS m FROM n)
"""


def _answers(spark: SparkSession, sf_dir: str, field: str, *columns: str) -> DataFrame:
    """The items as the JSON of an answer in a code fence; broken answers are cut off."""
    items = derived(spark, sf_dir, "answer_items")
    whole = items.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*columns).alias("item")))).alias("xs"), F.first("broken").alias("broken"))
    body = F.to_json(F.struct(F.transform("xs", lambda x: x["item"]).alias(field)))
    text = F.when(F.col("broken"), F.concat(F.lit("Sorry: "), F.left(body, F.lit(20)))).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return env.parsed(whole.select("answer_id", text.alias("answer")))


def _allowed(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", F.explode(F.array(*[F.lit(f"S{i}") for i in range(4)])).alias("source_id"))


@Q.add("answer_figures", ANSWERS + """SELECT answer_id, pos, CASE WHEN source_id IS NULL THEN 'source_id is required' WHEN source_id NOT IN ('S0', 'S1', 'S2', 'S3') THEN 'unknown source_id' WHEN m = '' THEN 'metric_key is required' WHEN m = 'headcount' THEN 'unknown metric_key'
  WHEN v IS NULL THEN 'value must be a finite number' WHEN v < 0 AND m <> 'capex' THEN 'value out of range' WHEN u IS NULL THEN 'unit is required' WHEN q IS NULL THEN 'quote is required' ELSE '' END AS reason,
  m AS metric_key, coalesce(cast(CASE WHEN m = 'capex' THEN abs(v) ELSE v END * 10 AS bigint), -999) AS value FROM a""")
def answer_figures(spark, sf_dir):
    answers = _answers(spark, sf_dir, "figures", "source_id", "metric_key", "value", "unit", "quote")
    got = env.figures(answers, _allowed(answers))
    return got.select("answer_id", F.col("pos").cast("long").alias("pos"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("metric_key", F.lit("")).alias("metric_key"), F.coalesce((F.col("value") * 10).cast("long"), F.lit(-999)).alias("value"))


@Q.add("answer_claims", ANSWERS + "SELECT answer_id, pos, CASE WHEN source_id IS NULL THEN 'source_id is required' WHEN source_id NOT IN ('S0', 'S1', 'S2', 'S3') THEN 'unknown source_id' WHEN category = 'overall' THEN 'unknown category' WHEN u IS NULL THEN 'claim is required' WHEN q IS NULL THEN 'quote is required' ELSE '' END AS reason FROM a")
def answer_claims(spark, sf_dir):
    items = "source_id", "category", F.col("unit").alias("claim"), "quote"
    answers = _answers(spark, sf_dir, "claims", *items)
    return env.claims(answers, _allowed(answers)).select("answer_id", F.col("pos").cast("long").alias("pos"), F.coalesce("reason", F.lit("")).alias("reason"))


@Q.add("answer_judgements", ANSWERS + f""", f AS (SELECT answer_id, category, arg_min(coalesce(score, ''), pos) AS s, arg_min(ref, pos) AS ref FROM a WHERE category <> 'overall' GROUP BY ALL),
j AS (SELECT *, cast(regexp_extract(ref, '([0-9]+)', 1) AS bigint) AS id, try_cast(nullif(s, '') AS double) AS sc FROM f),
e AS (SELECT DISTINCT answer_id, c AS category FROM a, (VALUES {', '.join(f"('{c}')" for c in env.JUDGED)}) v(c))
SELECT answer_id, category, coalesce(cast(CASE WHEN sc BETWEEN 0 AND 10 AND id < 4 THEN sc * 10 END AS bigint), -1) AS score, NOT coalesce(sc BETWEEN 0 AND 10 AND id < 4, false) AS insufficient, coalesce(CASE WHEN id >= 4 THEN 1 ELSE 0 END, 0) AS n_dropped FROM e LEFT JOIN j USING (answer_id, category)""")
def answer_judgements(spark, sf_dir):
    answers = _answers(spark, sf_dir, "categories", "category", "score", F.array("ref").alias("evidence_ids")).where("fatal IS NULL")
    evidence = answers.select("answer_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("evidence_id"))
    return env.judgements(answers, evidence).select("answer_id", "category", F.coalesce((F.col("score") * 10).cast("long"), F.lit(-1)).alias("score"), "insufficient", "n_dropped")


@Q.add("evidence_records", with_sql("evidence") + r""", k AS (SELECT min(evidence_id) AS evidence_id FROM evidence GROUP BY lower(trim(regexp_replace(quote, '[\s\x0B]+', ' ', 'g'))), domain)
SELECT run_id, count(*) AS total, count(*) FILTER (verified) AS verified, count(k.evidence_id) AS distinct_quotes, count(*) FILTER (reason = 'forecast') AS forecast, count(*) FILTER (reason = 'unit not near') AS not_near FROM evidence LEFT JOIN k USING (evidence_id) GROUP BY run_id""")
def evidence_records(spark, sf_dir):
    e = derived(spark, sf_dir, "evidence")
    kept = e.join(rec.distinct_evidence(e), "evidence_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("distinct_quotes"))
    reasons = rec.reason_counts(e, "run_id", "reason")
    n = lambda k: F.coalesce(F.try_element_at("reasons", F.lit(k)), F.lit(0))
    return rec.evidence_counts(e).join(kept, "run_id", "left").join(reasons, "run_id", "left").select("run_id", "total", "verified", F.coalesce("distinct_quotes", F.lit(0)).alias("distinct_quotes"), n("forecast").alias("forecast"), n("unit not near").alias("not_near"))


@Q.add("evidence_lists", with_sql("evidence") + "SELECT run_id AS owner_id, array_to_string(list(evidence_id ORDER BY evidence_id DESC) FILTER (verified), ',') AS ids, md5(array_to_string(list(quote ORDER BY evidence_id DESC) FILTER (verified), '|')) AS quotes FROM evidence GROUP BY run_id HAVING count(*) FILTER (verified) > 0")
def evidence_lists(spark, sf_dir):
    e = derived(spark, sf_dir, "evidence")
    owners = e.groupBy(F.col("run_id").alias("owner_id")).agg(F.sort_array(F.collect_list("evidence_id"), asc=False).alias("evidence_ids"))
    got = rec.evidence_lists(owners, e.where("verified")).where(F.size("evidence_ids") > 0)
    return got.select("owner_id", F.array_join("evidence_ids", ",").alias("ids"), F.md5(F.array_join("quotes", "|")).alias("quotes"))


@Q.add("distinct_claims", with_sql("evidence") + "SELECT min(evidence_id) AS claim_id FROM evidence GROUP BY run_id, claim_start")
def distinct_claims(spark, sf_dir):
    e = derived(spark, sf_dir, "evidence")
    return rec.distinct_claims(e.select(F.col("evidence_id").alias("claim_id"), F.col("run_id").alias("source_id"), F.col("claim_start").alias("start"), F.lit(1).alias("end")))


@Q.add("latest_scores", with_sql("judged") + """, l AS (SELECT entity_id, category, score FROM judged WHERE model <> 'stub' QUALIFY row_number() OVER (PARTITION BY entity_id, category ORDER BY judged_at DESC, score_id DESC, score DESC) = 1)
SELECT entity_id, CASE WHEN count(l.category) = 4 THEN 'ranked' ELSE 'awaiting' END AS status, CASE WHEN count(l.category) = 4 THEN (cast(round(sum(l.score) * 5) AS bigint) + 1) // 2 ELSE -1 END AS overall, count(l.category) AS n_scores FROM (SELECT DISTINCT entity_id FROM judged) LEFT JOIN l USING (entity_id) GROUP BY entity_id""")
def latest_scores(spark, sf_dir):
    got = rec.latest_scores(derived(spark, sf_dir, "judged"), ("a", "b", "c", "d"))
    return got.select("entity_id", "status", F.coalesce(F.floor(F.col("overall") * 10 + 0.5).cast("long"), F.lit(-1)).alias("overall"), "n_scores")


@Q.add("history_compare", RUNS + """, d AS (SELECT run_id, company_id, finished_at, CASE WHEN status <> 'succeeded' THEN status || coalesce(' (' || error_type || ')', '') WHEN retracted THEN 'retracted' WHEN degraded THEN 'degraded' WHEN published THEN 'published' ELSE 'withheld' END AS label,
  index_score - last_value(index_score IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta FROM st)
SELECT company_id, run_id, row_number() OVER (PARTITION BY company_id ORDER BY finished_at DESC, run_id DESC) AS place, label, coalesce(n, 0) AS n_sources, coalesce(cast(floor(delta * 100 + 0.5) AS bigint), -9999) AS delta FROM d LEFT JOIN (SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1) USING (run_id)""")
def history_compare(spark, sf_dir):
    got = rec.history_compare(s.rank_status(derived(spark, sf_dir, "runs")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")))
    return got.withColumn("delta", F.coalesce(F.floor(F.col("delta") * 100 + 0.5).cast("long"), F.lit(-9999)))


@Q.add("ready_runs", with_sql("waiting") + f"SELECT run_id, row_number() OVER (ORDER BY queued_at, run_id) AS place FROM waiting WHERE status = 'queued' AND (next_attempt IS NULL OR next_attempt <= {NOW}) ORDER BY queued_at, run_id LIMIT 5")
def ready_runs(spark, sf_dir):
    return rec.next_runs(derived(spark, sf_dir, "waiting"), F.expr(NOW))


@Q.add("scheduled_runs", with_sql("waiting") + f"SELECT run_id, cast(ceil((epoch_us(next_attempt) - epoch_us({NOW})) / 60e6) AS bigint) AS minutes FROM waiting WHERE status = 'queued' AND next_attempt > {NOW}")
def scheduled_runs(spark, sf_dir):
    return rec.scheduled_runs(derived(spark, sf_dir, "waiting"), F.expr(NOW))


@Q.add("retry_schedule", with_sql("waiting") + "SELECT run_id, CASE WHEN attempt < 4 THEN [2, 10, 60][cast(least(greatest(attempt, 1), 3) AS integer)] ELSE -1 END AS minutes, CASE WHEN attempt < 3 THEN [6, 24, 72][cast(attempt + 1 AS integer)] ELSE -1 END AS hours FROM waiting")
def retry_schedule(spark, sf_dir):
    a = F.col("attempt")
    return derived(spark, sf_dir, "waiting").select("run_id", F.coalesce(rec.retry_after(a), F.lit(-1)).alias("minutes"), F.coalesce(rec.energy_retry_after(a), F.lit(-1)).alias("hours"))


@Q.add("pending_stages", "SELECT o_orderkey AS run_id, ['resolve', 'research', 'edgar', 'fetch', 'extract', 'compute', 'judge', 'aggregate', 'compute'][cast(o_orderkey % 9 + 1 AS integer)] AS first, cast(8 - o_orderkey % 9 + CASE WHEN o_orderkey % 9 > 7 THEN 2 WHEN o_orderkey % 9 > 5 THEN 1 ELSE 0 END AS integer) AS n FROM orders")
def pending_stages(spark, sf_dir):
    done = F.slice(F.array(*[F.lit(x) for x in rec.STAGES]), F.lit(1), (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), rec.first_pending(done).alias("first"), F.size(rec.stages_to_run(done)).alias("n"))


@Q.add("run_documents", with_sql("runs", "category_scores") + """, c AS (SELECT run_id, count(*) AS n, max(cast(score * 10 AS bigint)) AS top, arg_min(category, ordinal) AS first FROM category_scores GROUP BY run_id), sc AS (SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1)
SELECT run_id, status, coalesce(cast(floor(index_score * 100 + 0.5) AS bigint), -1) AS index_score, coalesce(n, 0) AS n_categories, coalesce(first, '') AS first, coalesce(a, 0) AS a FROM runs LEFT JOIN c USING (run_id) LEFT JOIN sc USING (run_id)""")
def run_documents(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("status"))
    docs = rec.run_documents(derived(spark, sf_dir, "runs"), derived(spark, sf_dir, "category_scores"), sources)
    read = lambda path: F.get_json_object("document", path)
    n = F.coalesce(F.json_array_length(read("$.categories")), F.lit(0)).cast("long")
    return docs.select("run_id", read("$.status").alias("status"), F.coalesce(F.floor(read("$.scores.index_score").cast("double") * 100 + 0.5).cast("long"), F.lit(-1)).alias("index_score"), n.alias("n_categories"), F.coalesce(read("$.categories[0].category"), F.lit("")).alias("first"), F.coalesce(read("$.sources.A").cast("long"), F.lit(0)).alias("a"))


@Q.add("company_dossier", RUNS + """, cr AS (SELECT rp.company_id, current_run, len(public_runs) AS n_public FROM rp WHERE current_run IS NOT NULL)
SELECT co.company_id AS company_id, name, coalesce(n_runs, 0) AS n_runs, coalesce(current_run, -1) AS current_run, coalesce(n_public, -1) AS n_public, coalesce(k, -1) AS n_categories FROM companies co LEFT JOIN (SELECT company_id, count(*) AS n_runs FROM runs GROUP BY 1) USING (company_id)
LEFT JOIN cr USING (company_id) LEFT JOIN (SELECT l_orderkey AS current_run, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1) USING (current_run)""")
def company_dossier(spark, sf_dir):
    runs, companies = s.rank_status(derived(spark, sf_dir, "runs")), derived(spark, sf_dir, "companies")
    got = rec.dossier(companies, runs, r.replay(runs, companies), derived(spark, sf_dir, "category_scores"))
    missing = lambda c: F.coalesce(c, F.lit(-1))
    return got.select("company_id", "name", "n_runs", missing(F.col("current.run_id")).alias("current_run"), missing(F.col("current.n_public")).alias("n_public"), missing(F.when(F.col("current.categories").isNotNull(), F.size("current.categories"))).cast("long").alias("n_categories"))


@Q.add("publish_backfill", RUNS + "SELECT st.run_id AS run_id, published IS NULL AS unknown, pb.run_id IS NOT NULL AS published FROM st LEFT JOIN (SELECT DISTINCT run_id FROM pb) pb ON pb.run_id = st.run_id WHERE status = 'succeeded' AND st.published IS DISTINCT FROM (pb.run_id IS NOT NULL)")
def publish_backfill(spark, sf_dir):
    runs, companies = s.rank_status(derived(spark, sf_dir, "runs")), derived(spark, sf_dir, "companies")
    return pub.publish_backfill(runs, r.replay(runs, companies)).select("run_id", F.col("was").isNull().alias("unknown"), "published")


@Q.add("retractions", RUNS + """, q AS (SELECT run_id AS rid, CASE WHEN run_id % 2 = 0 THEN 'retract' ELSE 'unretract' END AS action, CASE WHEN run_id % 5 = 0 THEN 'short' ELSE 'a reason that is long enough' END AS why FROM runs WHERE run_id % 3 = 0)
SELECT rid AS run_id, CASE WHEN action = 'retract' AND status <> 'succeeded' THEN 'only a completed run can be retracted' WHEN action = 'retract' AND retracted THEN 'already retracted' WHEN action = 'retract' AND length(why) < 10 THEN 'reason too short' WHEN action = 'unretract' AND NOT retracted THEN 'not retracted' ELSE 'done' END AS outcome FROM q JOIN runs ON runs.run_id = rid""")
def retractions(spark, sf_dir):
    runs = derived(spark, sf_dir, "runs")
    i = F.col("run_id")
    asked = runs.where("run_id % 3 = 0").select(i.alias("request_id"), "run_id", F.when(i % 2 == 0, "retract").otherwise("unretract").alias("action"), F.lit("admin").alias("by"), F.when(i % 5 == 0, "  short ").otherwise("a reason  that is long enough").alias("reason"), F.col("finished_at").alias("at"))
    return pub.retract(runs, asked)[1].select("run_id", "outcome")


@Q.add("summary_alignment", with_sql("runs") + "SELECT run_id, CASE WHEN ranked THEN 'true' ELSE 'false' END AS ranked, CASE WHEN run_id % 3 = 0 THEN 'maybe' WHEN run_id % 4 <> 0 THEN CASE WHEN run_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END AS original FROM runs WHERE (run_id % 4 = 0) OR (CASE WHEN run_id % 2 = 0 THEN 'true' ELSE 'false' END) <> (CASE WHEN ranked THEN 'true' ELSE 'false' END)")
def summary_alignment(spark, sf_dir):
    i = F.col("run_id")
    stored = F.when(i % 4 != 0, F.create_map(F.lit("ranked"), F.when(i % 2 == 0, "true").otherwise("false"))).otherwise(F.create_map().cast("map<string,string>"))
    first = F.when(i % 3 == 0, F.create_map(F.lit("ranked_original"), F.lit("maybe"))).otherwise(F.create_map().cast("map<string,string>"))
    runs = derived(spark, sf_dir, "runs").select("run_id", "ranked", F.map_concat(stored, first).alias("summary"))
    out = pub.aligned_summaries(runs)
    return out.select("run_id", F.col("summary")["ranked"].alias("ranked"), F.coalesce(F.try_element_at("summary", F.lit("ranked_original")), F.lit("")).alias("original"))


@Q.add("added_companies", "SELECT lower(p_name) AS name_key, min(p_partkey) AS proposal_id FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 2 = 0) GROUP BY 1")
def added_companies(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name_key"), F.col("p_partkey").alias("proposal_id"))
    return pub.added_companies(rows, rows.where("proposal_id % 2 = 0"))


@Q.add("legacy_companies", with_sql("runs") + "SELECT DISTINCT company_id FROM runs WHERE version IS NULL OR company_id % 50 = 3 AND company_id IN (SELECT company_id FROM runs)")
def legacy_companies(spark, sf_dir):
    runs = derived(spark, sf_dir, "runs")
    scores = runs.where("company_id % 50 = 3").select("company_id", F.lit(None).cast("long").alias("run_id"))
    return pub.legacy_companies(runs.select("company_id").distinct(), scores, runs)


@Q.add("host_labels", DISCLOSED + """, l AS (SELECT host, count(*) AS total, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (status = 'dead' AND http_status = 404) AS dead_404, count(*) FILTER (status = 'thin') AS thin, count(*) FILTER (outcome = 'used') AS used FROM dl GROUP BY host)
SELECT * FROM l WHERE failed > 0 ORDER BY failed DESC, host LIMIT 10""")
def host_labels(spark, sf_dir):
    got = rec.host_labels(_links(spark, sf_dir), url.host_of(F.col("url")), F.col("status"), F.col("http_status"), F.col("outcome"))
    n = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(0))
    return got.select("host", "total", "failed", n("dead:404").alias("dead_404"), n("thin").alias("thin"), n("archive:used").alias("used"))


@Q.add("source_order", with_sql("source_docs") + "SELECT run_id, source_id, row_number() OVER (PARTITION BY run_id ORDER BY is_primary DESC, source_id) AS place FROM source_docs")
def source_order(spark, sf_dir):
    return rec.source_order(derived(spark, sf_dir, "source_docs"))


@Q.add("shown_numbers", r"""WITH v AS (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS n, o_orderkey * 997 AS ms FROM orders)
SELECT o_orderkey, format('{:,}', n) AS whole, CASE WHEN ms < 60000 THEN '' WHEN round(ms / 1000.0) < 3600 THEN cast(round(ms / 1000.0) AS bigint) // 60 || 'm ' || lpad(cast(cast(round(ms / 1000.0) AS bigint) % 60 AS varchar), 2, '0') || 's'
  ELSE cast(round(ms / 1000.0) AS bigint) // 3600 || 'h ' || lpad(cast(cast(round(ms / 1000.0) AS bigint) // 60 % 60 AS varchar), 2, '0') || 'm' END AS duration FROM v""")
def shown_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ms = F.col("o_orderkey") * 997
    return o.select("o_orderkey", rec.shown_number(F.floor("o_totalprice").cast("double")).alias("whole"), F.when(ms < 60000, "").otherwise(rec.shown_duration(ms)).alias("duration"))


@Q.add("implausible_figures", with_sql("figures") + f", b(metric_key, most) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in fg.MOST.items())}) SELECT figure_id, coalesce(CASE WHEN value * 1e7 > most THEN 'implausibly large' WHEN metric_key IN ('capex', 'revenue') AND value * 1e7 < 1e5 THEN 'implausibly small' END, '') AS verdict, CASE WHEN starts_with(metric_key, 'energy') OR starts_with(metric_key, 'electricity') THEN 'energy_throughput' WHEN starts_with(metric_key, 'datacenter') THEN 'compute_capacity' ELSE 'growth' END AS category FROM figures JOIN b USING (metric_key)")
def implausible_figures(spark, sf_dir):
    f = derived(spark, sf_dir, "figures")
    return f.select("figure_id", F.coalesce(fg.implausible(F.col("metric_key"), F.col("value") * 1e7), F.lit("")).alias("verdict"), fg.metric_category(F.col("metric_key")).alias("category"))


QUERIES, ORACLE = Q.functions, Q.sql
