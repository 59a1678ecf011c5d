"""Rules of a running service on awkward rows: nulls, ties, repeats, empty tables."""

import hashlib
import json
import re

import pytest
from factweir.operators import envelopes, service
from factweir.plans import registry
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_new_candidates(spark):
    found = [(1, 3, "http://A.com/x/"), (1, 2, "http://a.com/x#y"), (1, 4, "http://a.com/known/"), (1, 5, None), (1, 6, "http://a.com/b"), (1, 6, "http://a.com/a"), (1, 9, "http://a.com/z"), (2, 1, "http://a.com/x")]
    known = [(1, "HTTP://a.com/known"), (1, None), (2, "http://b.com/"), (None, "http://a.com/x")]
    run = lambda f, most: sorted(map(tuple, service.new_candidates(spark.createDataFrame(f, "run_id long, seq int, url string"), spark.createDataFrame(known, "run_id long, url string"), most).collect()))
    assert run(found, 3) == [(1, 1, "http://a.com/x#y"), (1, 2, "http://a.com/a"), (1, 3, "http://a.com/b"), (2, 1, "http://a.com/x")]
    assert run(found, 1) == [(1, 1, "http://a.com/x#y"), (2, 1, "http://a.com/x")] and run([], 3) == []


def test_run_requests(spark):
    runs = [(10, 1, "queued", "2024-01-05"), (11, 2, "queued", None), (12, 3, "running", "2024-01-05"), (13, 4, "succeeded", None), (14, 5, "queued", "2024-01-05"), (9, 5, "running", None), (15, 6, "queued", "2023-12-01")]
    asked = [(1, 1, "manual"), (2, 1, "manual"), (3, 1, "sweep"), (4, 2, "manual"), (5, 3, None), (6, 4, "sweep"), (7, 4, "manual"), (8, 5, None), (9, 6, "manual"), (10, 7, None)]
    r = spark.createDataFrame(runs, "run_id long, company_id long, status string, next_attempt string").withColumn("next_attempt", F.col("next_attempt").cast("timestamp"))
    got = {x.request_id: (x.outcome, x.run_id) for x in service.run_requests(spark.createDataFrame(asked, "request_id long, company_id long, run_trigger string"), r, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("run now", 10), 2: ("exists", 10), 3: ("exists", 10), 4: ("exists", 11), 5: ("exists", 12), 6: ("created", None), 7: ("exists", None), 8: ("run now", 14), 9: ("exists", 15), 10: ("created", None)}


@pytest.mark.parametrize(("now", "last", "due"), [("2024-01-02 10:00:00", None, True), ("2024-01-02 09:59:59", None, False), ("2024-01-02 23:00:00", "2024-01-02 10:00:00", False), ("2024-01-02 10:00:00", "2024-01-01 23:59:59", True), (None, None, None)])
def test_daily_jobs(spark, now, last, due):
    assert value(spark, service.is_due(F.lit(now).cast("timestamp"), F.lit(last).cast("timestamp"), 10)) is due


def test_daily_jobs_by_zone(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    assert value(spark, service.is_due(at("2024-01-02 10:00:00"), at("2024-01-01 11:00:00"), 2, "America/Los_Angeles")) is True  # 2 o'clock there
    assert value(spark, service.is_due(at("2024-01-03 07:00:00"), at("2024-01-02 11:00:00"), 2, "America/Los_Angeles")) is False  # still the day before there


@pytest.mark.parametrize(("attempt", "asked", "draw", "want"), [(1, None, 0.0, 1.0), (1, None, 1.0, 2.0), (3, None, 0.5, 6.0), (20, None, 1.0, 60.0), (1, 5.0, 0.0, 5.0), (1, 500.0, 0.0, 60.0), (1, -3.0, 0.0, 0.0)])
def test_back_off(spark, attempt, asked, draw, want):
    assert value(spark, service.backoff_seconds(F.lit(attempt), F.lit(asked).cast("double"), F.lit(draw))) == want


@pytest.mark.parametrize(("body", "kind", "want"), [(b"x" * 10, "text/html", (b"xxxxx", True)), (b"%PDF-xxx", "text/html", (b"%PDF-xx", True)), (b"xxxxx", None, (b"xxxxx", False)), (b"", "text/html", (b"", False)), (b"x" * 9, "application/PDF", (b"xxxxxxx", True)), (b"\xff" * 5, "", (b"\xff" * 5, False))])
def test_body_caps(spark, body, kind, want):
    got = value(spark, service.capped_body(F.lit(body), F.lit(kind).cast("string"), 100, 5, 7))
    assert (bytes(got.body), got.truncated) == want
    assert value(spark, service.capped_body(F.lit(None).cast("binary"), F.lit("text/html"), 5)).body is None


def test_hash_of_a_bundle(spark):
    a, b = (F.create_map(*[F.lit(x) for kv in pairs for x in kv]) for pairs in ([("b", 0.5), ("a", 1.0)], [("a", 1.0), ("b", 0.5)]))
    want = hashlib.sha256(b'{"a":1.0,"b":0.5}').hexdigest()
    assert value(spark, service.bundle_hash(a)) == value(spark, service.bundle_hash(b)) == want
    assert value(spark, service.canonical_json(F.create_map().cast("map<string,double>"))) == "{}" and value(spark, service.bundle_hash(F.lit(None).cast("map<string,double>"))) is None


def test_resolved_entities(spark):
    good = {"official_name": " Acme  Inc ", "domain": "https://WWW.acme.com/about", "ticker": "acm", "exchange": "NYSE", "is_public": "true", "confidence": "0.9"}
    rows = [(1, json.dumps(good)), (2, json.dumps({"official_name": "", "confidence": "0.5"})), (3, json.dumps({"official_name": "X", "confidence": "7"})), (4, None), (5, json.dumps({"official_name": "Y"})), (6, "not json")]
    got = {r.answer_id: r for r in envelopes.resolved(spark.createDataFrame(rows, "answer_id long, json string")).collect()}
    one = got[1]
    assert (one.domain, one.ticker, one.exchange, one.is_public, one.confidence, one.fatal) == ("acme.com", "ACM", "NYSE", True, 0.9, None) and one.official_name.split() == ["Acme", "Inc"]
    assert got[2].fatal == "official_name is required" and got[3].fatal == "confidence out of range" and got[4].fatal == "no object" and got[5].confidence == 0.5 and got[5].fatal is None and got[6].fatal is not None


def test_sources_of_a_research_answer(spark):
    body = {"sources": [{"url": " https://a.example/x ", "title": "T", "covers": ["energy"], "why": "w" * 500}, {"url": "ftp://b/"}, {"url": "http://c.example/"}, {}]}
    rows = [(1, json.dumps({"sources": [{**s, "url": s["url"].strip()} if "url" in s else s for s in body["sources"]]})), (2, None), (3, json.dumps({"sources": []})), (4, "broken")]
    got = sorted(envelopes.research(spark.createDataFrame(rows, "answer_id long, json string")).collect(), key=lambda r: r.pos)
    assert [(r.answer_id, r.url, list(r.covers)) for r in got] == [(1, "https://a.example/x", ["energy"]), (1, "http://c.example/", [])]
    assert len(got[0].why) == 200


def test_what_runs_share_meets_companies_in_a_broadcast_join(spark, data):
    """Evidence and sources aren't repeated for each run in a shuffle."""
    plan = registry.queries()["full_dossier"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "rightHint=(strategy=broadcast)" in joins[0]
    assert not any("quote" in line for line in plan[: plan.index("rightHint")].splitlines())


def test_texts_of_shared_evidence_are_not_shuffled(spark, data):
    """Joins and groups get digests of quotes, not the quotes."""
    plan = registry.queries()["full_dossier"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and not re.search(r"\bquote#", plan)


def test_a_written_dossier_holds_shared_lists_once_a_file(spark, tmp_path):
    """Sets have lists of 42 kB, together more than Parquet's dictionary of a file holds; a set's companies are far apart."""
    n, sets = 4000, 40
    ids = spark.range(n).select(F.col("id").alias("company_id"))
    runs = ids.select(F.col("company_id").alias("run_id"), "company_id", F.lit("succeeded").alias("status"))
    scores = ids.select(F.col("company_id").alias("run_id"), F.lit(1).alias("ordinal"), F.lit("growth").alias("category"))
    sources = spark.range(sets * 6000).select((F.col("id") % sets).alias("set_id"), (F.col("id") + 100_000).alias("source_id"), F.lit("http://a.example/").alias("url"), F.lit("ok").alias("status"), F.lit(True).alias("is_primary"))
    evidence = sources.where("source_id < 100002").select("set_id", F.col("source_id").alias("evidence_id"), "source_id", F.lit("q").alias("quote"), F.lit(True).alias("verified"))
    cited = evidence.select("set_id", F.lit(1).alias("ordinal"), F.col("evidence_id").alias("pos"), "evidence_id")
    got = service.shared_dossier(ids.withColumn("name", F.lit("x")), runs, runs.select("company_id", "run_id", F.col("run_id").alias("current_run")), scores, F.col("run_id") % sets, cited, evidence, sources)
    got.write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    seen = back.select((F.col("current_run") % sets).alias("s"), "company_id", F.length("sources").alias("n"), F.substring_index("sources", " ", 1).cast("long").alias("first"), "categories").collect()
    assert len({r.company_id for r in seen}) == len(seen) == n and all(r.n == 6000 * 7 - 1 and r.first == 100_000 + r.s for r in seen)
    assert {r.s: r.categories for r in seen if r.s < 3} == {0: "growth:100000", 1: "growth:100001", 2: "growth:"}
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 10e6
