"""Queries over runs and category scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.operators import lists as ls
from factweir.operators import records as rec
from factweir.operators import runs as r
from factweir.operators import scoring as s
from factweir.plans.query import Queries
from factweir.sources.derive import NOW, derived, with_sql

Q = Queries()

_W = "CASE category " + " ".join(f"WHEN '{k}' THEN {w!r}::double" for k, w in s.WEIGHTS.items()) + " END"
_MEASURED = ", ".join(f"'{k}'" for k in s.MEASURED)
INDEX = with_sql("category_scores") + f""", p AS (SELECT *, {_W} AS w, category IN ({_MEASURED}) AS m FROM category_scores),
a AS (SELECT run_id, floor(sum(w * score) FILTER (score IS NOT NULL) / nullif(sum(w) FILTER (score IS NOT NULL), 0) * 100 + 0.5 + 1e-9) / 100 AS index_score,
  floor(sum(w * score) FILTER (m AND score IS NOT NULL) / nullif(sum(w) FILTER (m AND score IS NOT NULL), 0) * 100 + 0.5 + 1e-9) / 100 AS measured_score,
  floor(coalesce(sum(w) FILTER (score IS NOT NULL), 0) * 1e4 + 0.5 + 1e-9) / 1e4 AS coverage,
  floor(coalesce(sum(w) FILTER (m AND score IS NOT NULL), 0) * 1e4 + 0.5 + 1e-9) / 1e4 AS measured_coverage,
  floor(coalesce(sum(w * greatest(0, least(1, confidence))) FILTER (score IS NOT NULL), 0) * 1e3 + 0.5 + 1e-9) / 1e3 AS conf,
  coalesce(bool_or(category = 'energy_throughput' AND score IS NOT NULL AND w IS NOT NULL), false) AS has_energy FROM p GROUP BY run_id),
b AS (SELECT *, CASE WHEN coverage < 0.6::double THEN 'insufficient data' WHEN measured_coverage < 0.3::double THEN 'insufficient measured data' END AS short, floor(coverage / (1 - 0.3::double) * 1e4 + 0.5 + 1e-9) / 1e4 AS adj FROM a),
c AS (SELECT *, short IS NOT NULL AND NOT has_energy AS und, short IS NOT NULL AND NOT has_energy AND adj >= 0.6::double AND measured_coverage >= 0.15::double - 1e-9 AS relaxed FROM b),
d AS (SELECT *, CASE WHEN relaxed THEN floor(conf * 0.8::double * 1e3 + 0.5 + 1e-9) / 1e3 ELSE conf END AS confidence FROM c),
e AS (SELECT *, CASE WHEN NOT (coalesce(floor(measured_coverage / nullif(coverage, 0) * 1e4 + 0.5 + 1e-9) / 1e4, 0) > 0.4::double) THEN 'too little measured data' WHEN NOT (confidence > 0.2::double) THEN 'low confidence' END AS gate FROM d),
idx AS (SELECT run_id, index_score, measured_score, coverage, measured_coverage, confidence, CASE WHEN und THEN 'energy_undisclosed' ELSE 'standard' END AS basis,
  CASE WHEN relaxed THEN gate WHEN und THEN 'insufficient data: energy undisclosed' WHEN short IS NOT NULL THEN short ELSE gate END AS reason FROM e)
"""

RUNS = with_sql("runs", "companies") + r""", st AS (SELECT *, CASE WHEN NOT ranked THEN coalesce(regexp_replace(reason, '; retry scheduled$', ''), 'insufficient data')
    WHEN NOT (coalesce(floor(measured_coverage / nullif(coverage, 0) * 1e4 + 0.5 + 1e-9) / 1e4, 0) > 0.4::double) THEN 'too little measured data'
    WHEN NOT (coalesce(confidence, 0) > 0.2::double) THEN 'low confidence' END AS rank_reason,
    coalesce(list_transform(string_split(nullif(regexp_extract(coalesce(version, ''), 'v([0-9.]+)', 1), ''), '.'), lambda x: cast(x AS integer)), []) AS vk FROM runs),
o AS (SELECT st.*, has_legacy, rank_reason IS NULL AS is_ranked, row_number() OVER (PARTITION BY company_id ORDER BY finished_at, run_id) AS rn
  FROM st JOIN companies USING (company_id) WHERE status = 'succeeded'),
f(company_id, rn, cur, cr, cc, cv, seen, pub, rest) AS (
  SELECT DISTINCT company_id, 0::bigint, NULL::bigint, false, NULL::double, NULL::integer[], false, []::bigint[], NULL::bigint FROM o
  UNION ALL
  SELECT company_id, rn, CASE WHEN sh THEN run_id ELSE cur END, CASE WHEN sh THEN is_ranked ELSE cr END, CASE WHEN sh THEN coverage ELSE cc END, CASE WHEN sh THEN vk ELSE cv END,
    seen OR retracted, CASE WHEN sh THEN list_append(pub, run_id) ELSE pub END, CASE WHEN retracted THEN rest ELSE run_id END
  FROM (SELECT f.company_id, o.rn, o.run_id, o.is_ranked, o.coverage, o.vk, o.retracted, f.cur, f.cr, f.cc, f.cv, f.seen, f.pub, f.rest,
      NOT o.retracted AND (CASE WHEN f.seen THEN CASE WHEN o.ranked THEN true WHEN f.cur IS NOT NULL THEN NOT f.cr AND NOT (coalesce(f.cc, 0) > coalesce(o.coverage, 0)) ELSE NOT o.has_legacy END
        ELSE coalesce(o.published, false) END OR coalesce(f.cur IS NOT NULL AND NOT o.degraded AND o.basis <> 'energy_unreadable' AND o.vk > f.cv, false)) AS sh
    FROM f JOIN o ON o.company_id = f.company_id AND o.rn = f.rn + 1)),
rp AS (SELECT company_id, CASE WHEN cur IS NULL AND seen THEN rest ELSE cur END AS current_run,
    CASE WHEN cur IS NULL AND seen AND rest IS NOT NULL THEN [rest] ELSE pub END AS public_runs FROM f QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY rn DESC) = 1),
pb AS (SELECT company_id, current_run, unnest(public_runs) AS run_id FROM rp)
"""
_SINCE = "TIMESTAMP '2001-04-16 12:00:00'"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.rank_status(derived(spark, sf_dir, "runs"))


def _replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs, companies = _runs(spark, sf_dir), derived(spark, sf_dir, "companies")
    return companies, runs, r.replay(runs, companies)


def _cents(c: str) -> F.Column:
    return F.floor(F.col(c) * 100 + 0.5).cast("long").alias(c)


def _c(c: str) -> str:
    return f"cast(floor({c} * 100 + 0.5) AS bigint) AS {c}"


@Q.add("aggregate_index", INDEX + f"SELECT run_id, coalesce(cast(floor(index_score * 100 + 0.5) AS bigint), -1) AS index_score, {_c('coverage')}, {_c('measured_coverage')}, cast(floor(confidence * 1000 + 0.5) AS bigint) AS confidence, basis, reason IS NULL AS ranked, coalesce(reason, '') AS reason FROM idx")
def aggregate_index(spark, sf_dir):
    got = s.aggregate_index(derived(spark, sf_dir, "category_scores"))
    return got.select("run_id", F.coalesce(F.floor(F.col("index_score") * 100 + 0.5).cast("long"), F.lit(-1)).alias("index_score"), _cents("coverage"), _cents("measured_coverage"), F.floor(F.col("confidence") * 1000 + 0.5).cast("long").alias("confidence"), "basis", "ranked", F.coalesce("reason", F.lit("")).alias("reason"))


@Q.add("rank_status", RUNS + "SELECT run_id, rank_reason IS NULL AS is_ranked, coalesce(rank_reason, '') AS rank_reason FROM st")
def rank_status(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "is_ranked", F.coalesce("rank_reason", F.lit("")).alias("rank_reason"))


@Q.add("run_replay", RUNS + "SELECT company_id, run_id, current_run FROM pb")
def run_replay(spark, sf_dir):
    return _replay(spark, sf_dir)[2]


@Q.add("leaderboard", RUNS + f"SELECT row_number() OVER (ORDER BY coalesce(index_score, 0) DESC, name) AS place, company_id, name, run_id, {_c('index_score')} FROM companies JOIN rp USING (company_id) JOIN st ON st.run_id = rp.current_run WHERE rank_reason IS NULL ORDER BY place LIMIT 100".replace("company_id, name, run_id", "companies.company_id AS company_id, name, st.run_id AS run_id"))
def leaderboard(spark, sf_dir):
    companies, runs, rp = _replay(spark, sf_dir)
    return r.leaderboard(companies, runs, rp).select("place", "company_id", "name", "run_id", _cents("index_score"))


@Q.add("leaderboard_search", RUNS + "SELECT companies.company_id AS company_id, name FROM companies JOIN rp USING (company_id) JOIN st ON st.run_id = rp.current_run WHERE rank_reason IS NULL AND (name ILIKE '%mach%' OR industry ILIKE '%mach%' OR country ILIKE '%mach%') ORDER BY coalesce(index_score, 0) DESC, name LIMIT 20")
def leaderboard_search(spark, sf_dir):
    companies, runs, rp = _replay(spark, sf_dir)
    return r.leaderboard(companies, runs, rp, q="mach", limit=20).select("company_id", "name")


@Q.add(
    "run_history",
    RUNS + """, h AS (SELECT pb.company_id, pb.current_run, pb.run_id, finished_at, index_score, rank_reason IS NULL AND index_score IS NOT NULL AS on_,
    row_number() OVER (PARTITION BY pb.company_id ORDER BY finished_at, pb.run_id) AS ordinal FROM pb JOIN st USING (run_id)
    WHERE pb.run_id = current_run OR NOT (coalesce(coverage, 0) = 0 AND index_score IS NULL)),
g AS (SELECT *, max(ordinal) FILTER (run_id = current_run) OVER (PARTITION BY company_id) AS cur_at,
    last_value(CASE WHEN on_ THEN index_score END IGNORE NULLS) OVER w AS bi, last_value(CASE WHEN on_ THEN ordinal END IGNORE NULLS) OVER w AS bo
  FROM h WINDOW w AS (PARTITION BY company_id ORDER BY finished_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT company_id, run_id, ordinal, CASE WHEN ordinal = cur_at THEN 'N' ELSE 'N' || CASE WHEN ordinal > cur_at THEN '+' ELSE '' END || (ordinal - cur_at) END AS label, run_id = current_run AS is_current,
  coalesce(CASE WHEN on_ AND bi IS NOT NULL THEN cast(floor((index_score - bi) * 100 + 0.5) AS bigint) END, -9999) AS delta,
  coalesce(CASE WHEN on_ AND bi IS NOT NULL THEN CASE WHEN bo = cur_at THEN 'N' ELSE 'N' || CASE WHEN bo > cur_at THEN '+' ELSE '' END || (bo - cur_at) END END, '') AS delta_vs FROM g""",
)
def run_history(spark, sf_dir):
    _, runs, rp = _replay(spark, sf_dir)
    got = r.history(runs, rp)
    return got.withColumns({"delta": F.coalesce(F.floor(F.col("delta") * 100 + 0.5).cast("long"), F.lit(-9999)), "delta_vs": F.coalesce("delta_vs", F.lit(""))})


@Q.add("withheld_runs", RUNS + """SELECT company_id, run_id, place FROM (SELECT o.company_id, o.run_id, row_number() OVER (PARTITION BY o.company_id ORDER BY o.finished_at DESC, o.run_id DESC) AS place
  FROM o JOIN rp USING (company_id) LEFT JOIN st c ON c.run_id = rp.current_run WHERE NOT o.retracted AND o.run_id NOT IN (SELECT run_id FROM pb) AND (c.finished_at IS NULL OR o.finished_at > c.finished_at)) WHERE place <= 3""")
def withheld_runs(spark, sf_dir):
    _, runs, rp = _replay(spark, sf_dir)
    return r.withheld(runs, rp)


@Q.add("company_board", RUNS + """, k AS (SELECT company_id, max(run_id) FILTER (status NOT IN ('queued', 'running')) AS latest_run, max(run_id) FILTER (status IN ('queued', 'running')) AS active_run,
    max(run_id) FILTER (retracted) AS retracted_run, count(*) AS n_runs FROM st GROUP BY company_id)
SELECT c.company_id, name, coalesce(current_run, -1) AS current_run, coalesce(latest_run, -1) AS latest_run, coalesce(active_run, -1) AS active_run, coalesce(retracted_run, -1) AS retracted_run, coalesce(n_runs, 0) AS n_runs,
  CASE WHEN n.run_id IS NOT NULL AND n.rank_reason IS NULL THEN 'ranked' WHEN n.basis = 'energy_unreadable' THEN 'energy'
    WHEN (l.status = 'failed' AND (current_run IS NULL OR latest_run > current_run)) OR n.degraded THEN 'degraded' WHEN n.confidence <= 0.2::double THEN 'confidence' ELSE 'coverage' END AS "group"
FROM companies c LEFT JOIN k USING (company_id) LEFT JOIN rp USING (company_id) LEFT JOIN st n ON n.run_id = current_run LEFT JOIN st l ON l.run_id = latest_run""")
def company_board(spark, sf_dir):
    companies, runs, rp = _replay(spark, sf_dir)
    return r.board(companies, runs, rp).fillna(-1, ["current_run", "latest_run", "active_run", "retracted_run"])


@Q.add("run_queue", RUNS + "SELECT run_id, company_id, name, CASE WHEN status = 'running' THEN 'running' WHEN run_trigger = 'energy_retry' THEN 'scheduled' ELSE 'queued' END AS bucket FROM runs JOIN companies USING (company_id) WHERE status IN ('queued', 'running')")
def run_queue(spark, sf_dir):
    return r.queue(derived(spark, sf_dir, "runs"), derived(spark, sf_dir, "companies"))


@Q.add("run_spend", RUNS + f"SELECT cast(sum(cost_cents) AS bigint) AS cents, count(*) AS n_runs, count(*) - count(cost_cents) AS unknown FROM runs WHERE finished_at >= {_SINCE}")
def run_spend(spark, sf_dir):
    return r.spend(derived(spark, sf_dir, "runs"), F.expr(_SINCE))


@Q.add("run_outcomes", RUNS + f"""SELECT outcome, count(*) AS n FROM (SELECT unnest([CASE WHEN status = 'failed' THEN 'failed:' || coalesce(error_type, 'unknown') END, CASE WHEN status = 'succeeded' THEN 'succeeded' END,
  CASE WHEN status = 'succeeded' AND degraded THEN 'degraded' END, CASE WHEN status = 'succeeded' AND basis = 'energy_unreadable' THEN 'energy_unreadable' END,
  CASE WHEN status = 'succeeded' AND NOT coalesce(published, false) THEN 'withheld' END, CASE WHEN status = 'succeeded' AND claims_verified = 0 THEN 'zero_claims' END]) AS outcome
  FROM runs WHERE finished_at >= {_SINCE}) WHERE outcome IS NOT NULL GROUP BY outcome""")
def run_outcomes(spark, sf_dir):
    return r.outcomes(derived(spark, sf_dir, "runs"), F.expr(_SINCE))


@Q.add("run_alerts", RUNS + f"""SELECT run_id, kind FROM (SELECT run_id, unnest([CASE WHEN status = 'failed' THEN 'failed' END,
  CASE WHEN status = 'queued' AND (error_type IS NOT NULL OR run_trigger = 'energy_retry') THEN 'retrying' END, CASE WHEN status = 'succeeded' AND degraded THEN 'degraded' END,
  CASE WHEN status = 'succeeded' AND NOT retracted AND run_id NOT IN (SELECT run_id FROM pb) THEN 'withheld' END,
  CASE WHEN status = 'succeeded' AND basis = 'energy_unreadable' THEN 'energy_unreadable' END]) AS kind
  FROM (SELECT * FROM runs WHERE finished_at >= {_SINCE} OR status IN ('queued', 'running') ORDER BY run_id DESC LIMIT 200)) WHERE kind IS NOT NULL""")
def run_alerts(spark, sf_dir):
    _, runs, rp = _replay(spark, sf_dir)
    return r.alerts(runs, rp, F.expr(_SINCE))


@Q.add("trigger_streak", RUNS + "SELECT company_id, coalesce(min(place) FILTER (run_trigger <> 'energy_retry') - 1, count(*)) AS streak FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY run_id DESC) AS place FROM runs) GROUP BY company_id")
def trigger_streak(spark, sf_dir):
    return r.streak(derived(spark, sf_dir, "runs"), "energy_retry")


@Q.add("category_deltas", with_sql("runs", "category_scores") + "SELECT run_id, category, coalesce(cast(floor((score - lag(score) OVER (PARTITION BY company_id, category ORDER BY finished_at, run_id)) * 10 + 0.5) AS bigint), -999) AS delta FROM category_scores JOIN runs USING (run_id)")
def category_deltas(spark, sf_dir):
    return ls.category_deltas(derived(spark, sf_dir, "category_scores"), derived(spark, sf_dir, "runs")).select("run_id", "category", F.coalesce(F.floor(F.col("delta") * 10 + 0.5).cast("long"), F.lit(-999)).alias("delta"))


@Q.add("category_pivot", with_sql("category_scores") + "SELECT run_id, " + ", ".join(f"coalesce(cast(floor(max(score) FILTER (category = '{k}') * 10 + 0.5) AS bigint), -1) AS {k}" for k in s.WEIGHTS) + " FROM category_scores GROUP BY run_id")
def category_pivot(spark, sf_dir):
    got = ls.category_pivot(derived(spark, sf_dir, "category_scores"), list(s.WEIGHTS))
    return got.select("run_id", *[F.coalesce(F.floor(F.col(k) * 10 + 0.5).cast("long"), F.lit(-1)).alias(k) for k in s.WEIGHTS])


@Q.add("runs_page", RUNS + "SELECT run_id, cast(ceil((SELECT count(*) FROM runs WHERE status = 'succeeded' AND published IS NOT TRUE) / 25.0) AS bigint) AS pages FROM runs WHERE status = 'succeeded' AND published IS NOT TRUE ORDER BY finished_at DESC, run_id DESC LIMIT 25 OFFSET 50")
def runs_page(spark, sf_dir):
    kept = derived(spark, sf_dir, "runs").where(F.expr("status = 'succeeded' AND NOT (published <=> true)"))
    return ls.page(kept, [F.desc("finished_at"), F.desc("run_id")], 3, 25).select("run_id", "pages")


@Q.add("retry_plan", RUNS + "SELECT run_id, element_at([2, 10, 60], least(1 + (tokens % 5), 3)) AS wait_minutes, tokens % 5 < 4 AS again FROM runs WHERE status = 'failed'".replace("element_at([2, 10, 60], least(1 + (tokens % 5), 3))", "cast([2, 10, 60][least(1 + (tokens % 5), 3)] AS integer)"))
def retry_plan(spark, sf_dir):
    attempt = F.col("tokens") % 5
    failed = derived(spark, sf_dir, "runs").where("status = 'failed'")
    return failed.select("run_id", F.coalesce(rec.retry_after(attempt + 1), F.lit(rec.RETRY_MINUTES[-1])).alias("wait_minutes"), (attempt < rec.RETRY_TRIES).alias("again"))


@Q.add("stale_running", RUNS + f"SELECT run_id, CASE WHEN tokens % 4 < 3 THEN 'requeue' ELSE 'fail' END AS action FROM runs WHERE status = 'running' AND finished_at < {NOW} - INTERVAL 180 SECOND")
def stale_running(spark, sf_dir):
    return ls.stale_running(derived(spark, sf_dir, "runs"), F.expr(NOW), F.col("tokens") % 4 < 3)


@Q.add("sweep_budget", RUNS + "SELECT run_id FROM (SELECT run_id, row_number() OVER (ORDER BY finished_at, run_id) AS n FROM o WHERE is_ranked) WHERE n <= floor(500 / 35.0)")
def sweep_budget(spark, sf_dir):
    ready = _runs(spark, sf_dir).where("status = 'succeeded' AND is_ranked").join(derived(spark, sf_dir, "companies"), "company_id", "left_semi")
    return ls.within_budget(ready, ["finished_at", "run_id"], 500, 35).select("run_id")


@Q.add("mean_recent_cost", RUNS + "SELECT cast(sum(cost_cents) AS bigint) AS cents, count(*) AS n FROM (SELECT cost_cents FROM runs WHERE status = 'succeeded' AND cost_cents > 0 ORDER BY run_id DESC LIMIT 10)")
def mean_recent_cost(spark, sf_dir):
    return ls.recent_cost(derived(spark, sf_dir, "runs"))


@Q.add("status_counts", with_sql("runs") + "SELECT coalesce(error_type, 'unknown') AS error_type, status, count(*) AS n, cast(coalesce(sum(tokens), 0) AS bigint) AS tokens FROM runs GROUP BY ALL")
def status_counts(spark, sf_dir):
    return ls.status_counts(derived(spark, sf_dir, "runs"))


@Q.add("stale_retry_claims", RUNS + "SELECT rp.company_id AS company_id, st.run_id AS run_id FROM rp JOIN st ON st.run_id = current_run WHERE rank_reason IS NOT NULL AND contains(reason, 'retry scheduled') AND rp.company_id NOT IN (SELECT company_id FROM runs WHERE status IN ('queued', 'running'))")
def stale_retry_claims(spark, sf_dir):
    _, runs, rp = _replay(spark, sf_dir)
    return ls.stale_retry_claims(runs, rp)


@Q.add("sparkline_points", RUNS + "SELECT pb.company_id AS key, run_id AS seq, cast(floor((CASE WHEN count(*) OVER (PARTITION BY pb.company_id) > 1 THEN (row_number() OVER (PARTITION BY pb.company_id ORDER BY run_id) - 1) * 120.0::double / (count(*) OVER (PARTITION BY pb.company_id) - 1) ELSE 60 END) * 10 + 0.5) AS bigint) AS x, coalesce(cast(floor((28 - least(10, greatest(0, index_score)) / 10 * 28) * 10 + 0.5) AS bigint), -1) AS y FROM pb JOIN st USING (run_id)")
def sparkline_points(spark, sf_dir):
    _, runs, rp = _replay(spark, sf_dir)
    rows = rp.select(F.col("company_id").alias("key"), F.col("run_id").alias("seq")).join(runs.select(F.col("run_id").alias("seq"), F.col("index_score").alias("value")), "seq")
    return r.sparkline(rows).select("key", "seq", F.floor(F.col("x") * 10 + 0.5).cast("long").alias("x"), F.coalesce(F.floor(F.col("y") * 10 + 0.5).cast("long"), F.lit(-1)).alias("y"))


@Q.add("company_record", RUNS + """SELECT company_id, run_id, status, n, last_run, top FROM runs JOIN (SELECT company_id, count(*) AS n, max(run_id) AS last_run, cast(max(array_to_string([status, run_trigger], ':')) AS string) AS top FROM runs GROUP BY company_id) USING (company_id)""")
def company_record(spark, sf_dir):
    return ls.company_record(derived(spark, sf_dir, "runs"))


QUERIES, ORACLE = Q.functions, Q.sql
