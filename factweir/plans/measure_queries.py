"""Queries over figures, with their SQL. Scores are compared as whole numbers of 1e-6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.operators import measures as m
from factweir.plans.query import Queries
from factweir.sources.derive import derived, with_sql

Q = Queries()
YEAR = 2002


def _micro(c: str) -> F.Column:
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)


def _m(c: str, name: str = "") -> str:
    return f"cast(floor(({c}) * 1e6 + 0.5) AS bigint) AS {name or c}"


_FAMILY = "CASE metric_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.METRIC_FAMILY.items()) + " END"
_UNITS = ", ".join(f"('{f}', '{k}', '{u}', {x!r}::double)" for f, k, u, x in m.unit_rows() if k in ("mwh", "gwh", "megawatthours", "tj", "mw", "kw", "megawatts", "usd", "$millions", "eur", "thousanddollars"))
SI = with_sql("figures") + rf""", units(family, spelling, canonical, factor) AS (VALUES {_UNITS}),
si AS (SELECT f.*, canonical, value * factor AS si, try_cast(nullif(regexp_extract(period, '((19|20)[0-9]{{2}})', 1), '') AS integer) AS year
  FROM figures f LEFT JOIN units u ON u.family = {_FAMILY} AND u.spelling = regexp_replace(lower(unit), '[\s,.-]+', '', 'g')),
u AS (SELECT *, coalesce(year, 0) AS y FROM si WHERE si > 0),
l AS (SELECT *, max(y) OVER k AS last FROM u WINDOW k AS (PARTITION BY entity_id, metric_key)),
g AS (SELECT *, bool_or(is_primary) OVER k AS anyp, max(si) OVER k / min(si) OVER k > 1.25 AS conflict FROM l WHERE y = last WINDOW k AS (PARTITION BY entity_id, metric_key)),
o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric_key ORDER BY si, figure_id) AS rn, count(*) OVER (PARTITION BY entity_id, metric_key) AS n FROM g WHERE is_primary OR NOT anyp),
picked AS (SELECT *, (CASE WHEN origin = 'edgar' THEN 0.95::double WHEN is_primary THEN 0.9::double ELSE 0.65::double END)
    * (CASE WHEN year IS NULL THEN 0.7::double WHEN year < {YEAR - 3} THEN 0.75::double ELSE 1 END) * (CASE WHEN conflict THEN 0.8::double ELSE 1 END) AS conf FROM o WHERE rn = n // 2 + 1),
yearly AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, metric_key, year ORDER BY origin = 'edgar' DESC, is_primary DESC, figure_id) AS r FROM u WHERE year IS NOT NULL) WHERE r = 1),
cg AS (SELECT a.entity_id, a.metric_key, a.year - b.year AS years, power(a.si / b.si, 1.0::double / (a.year - b.year)) - 1 AS cagr
  FROM (SELECT * FROM yearly QUALIFY year = max(year) OVER (PARTITION BY entity_id, metric_key)) a
  JOIN yearly b ON a.entity_id = b.entity_id AND a.metric_key = b.metric_key AND b.year BETWEEN a.year - 3 AND a.year - 1
  QUALIFY row_number() OVER (PARTITION BY a.entity_id, a.metric_key ORDER BY b.year) = 1),
bc AS (SELECT entity_id, metric_key, avg(CASE WHEN origin = 'edgar' THEN 0.95::double WHEN is_primary THEN 0.85::double ELSE 0.65::double END) AS base_conf FROM yearly GROUP BY ALL),
energy AS (SELECT entity_id, metric_key, figure_id, conflict, si, conf * CASE WHEN metric_key = 'electricity_consumption' THEN 0.9::double ELSE 1 END AS confidence
  FROM (SELECT *, bool_or(metric_key = 'energy_consumption') OVER (PARTITION BY entity_id) AS ha FROM picked WHERE metric_key IN ('energy_consumption', 'electricity_consumption', 'energy_generated'))
  WHERE NOT (metric_key = 'electricity_consumption' AND ha)
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY si DESC, CASE WHEN metric_key = 'energy_generated' THEN 0 ELSE 1 END DESC) = 1),
escore AS (SELECT *, greatest(0, least(10, 2.5 * (log10(si / 31557600.0::double) - 7))) AS score, (log10(si / 31557600.0::double) - 6) / 10 AS k FROM energy),
cscore AS (SELECT r.entity_id AS re, p.entity_id AS pe, r.figure_id, r.conflict, greatest(0, least(10, 2.5 * log10(r.si / 1e6))) AS score, r.conf AS confidence, p.si / 1e6 AS planned_mw
  FROM (SELECT * FROM picked WHERE metric_key = 'datacenter_capacity_operating') r FULL JOIN (SELECT * FROM picked WHERE metric_key = 'datacenter_capacity_planned') p USING (entity_id)),
fk AS (SELECT entity_id, min(CASE metric_key WHEN 'energy_consumption' THEN 1 WHEN 'electricity_consumption' THEN 2 WHEN 'energy_generated' THEN 3 END) AS f FROM figures GROUP BY entity_id),
gp AS (SELECT entity_id, cagr, base_conf, CASE metric_key WHEN 'capex' THEN 0.5::double ELSE 0.25::double END AS w,
    CASE WHEN cagr <= -0.3 THEN 0 WHEN cagr >= 1 THEN 10 WHEN cagr <= 0 THEN 3 * (cagr + 0.3::double) / 0.3::double WHEN cagr <= 0.1::double THEN 3 + 2 * cagr / 0.1::double
      WHEN cagr <= 0.25::double THEN 5 + 2 * (cagr - 0.1::double) / 0.15::double WHEN cagr <= 0.5::double THEN 7 + 2 * (cagr - 0.25::double) / 0.25::double ELSE 9 + (cagr - 0.5::double) / 0.5::double END AS s
  FROM cg JOIN bc USING (entity_id, metric_key) JOIN fk USING (entity_id)
  WHERE metric_key IN ('capex', 'revenue') OR f = CASE metric_key WHEN 'energy_consumption' THEN 1 WHEN 'electricity_consumption' THEN 2 WHEN 'energy_generated' THEN 3 END),
gscore AS (SELECT entity_id, sum(w * s) / sum(w) AS score, sum(w * base_conf) AS confidence, count(*) AS parts FROM gp GROUP BY entity_id)
"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.with_si(derived(spark, sf_dir, "figures"))


@Q.add("unit_conversion", SI + "SELECT figure_id, source_id, canonical, coalesce(cast(floor(si / 1e3) AS bigint), -1) AS si_thousands, coalesce(year, 0) AS year FROM si")
def unit_conversion(spark, sf_dir):
    return figures(spark, sf_dir).select("figure_id", "source_id", "canonical", F.coalesce(F.floor(F.col("si") / 1e3).cast("long"), F.lit(-1)).alias("si_thousands"), F.coalesce("year", F.lit(0)).alias("year"))


@Q.add("figure_pick", SI + "SELECT entity_id, metric_key, figure_id, year, is_primary, conflict FROM picked")
def figure_pick(spark, sf_dir):
    return m.picked(figures(spark, sf_dir)).select("entity_id", "metric_key", "figure_id", "year", "is_primary", "conflict")


@Q.add("figure_confidence", SI + f"SELECT entity_id, metric_key, {_m('conf', 'confidence')} FROM picked")
def figure_confidence(spark, sf_dir):
    return m.picked(figures(spark, sf_dir)).withColumn("confidence", m.figure_confidence(YEAR)).select("entity_id", "metric_key", _micro("confidence"))


@Q.add("figure_series", SI + "SELECT entity_id, metric_key, year, figure_id FROM yearly")
def figure_series(spark, sf_dir):
    return m.yearly(figures(spark, sf_dir)).select("entity_id", "metric_key", "year", "figure_id")


@Q.add("growth_cagr", SI + f"SELECT entity_id, metric_key, years, {_m('cagr')}, {_m('base_conf')} FROM cg JOIN bc USING (entity_id, metric_key)")
def growth_cagr(spark, sf_dir):
    return m.growth_rates(m.yearly(figures(spark, sf_dir))).select("entity_id", "metric_key", "years", _micro("cagr"), _micro("base_conf"))


@Q.add("measure_energy", SI + f"SELECT entity_id, metric_key, figure_id, conflict, {_m('score')}, {_m('k')}, {_m('confidence')} FROM escore")
def measure_energy(spark, sf_dir):
    return m.measure_energy(figures(spark, sf_dir), YEAR).select("entity_id", "metric_key", "figure_id", "conflict", _micro("score"), _micro("k"), _micro("confidence"))


@Q.add("measure_compute", SI + f"SELECT coalesce(re, pe) AS entity_id, coalesce(figure_id, -1) AS figure_id, coalesce(conflict, false) AS conflict, {_m('coalesce(score, -1)', 'score')}, {_m('coalesce(confidence, -1)', 'confidence')}, {_m('coalesce(planned_mw, -1)', 'planned_mw')} FROM (SELECT *, 0 AS x FROM cscore)")
def measure_compute(spark, sf_dir):
    got = m.measure_compute(figures(spark, sf_dir), YEAR).fillna(-1, ["figure_id", "score", "confidence", "planned_mw"]).fillna(False, ["conflict"])
    return got.select("entity_id", "figure_id", "conflict", _micro("score"), _micro("confidence"), _micro("planned_mw"))


@Q.add("measure_growth", SI + f"SELECT entity_id, {_m('score')}, {_m('confidence')}, parts FROM gscore")
def measure_growth(spark, sf_dir):
    return m.measure_growth(figures(spark, sf_dir)).select("entity_id", _micro("score"), _micro("confidence"), "parts")


@Q.add("measure_all", SI + f"SELECT entity_id, 'energy_throughput' AS category, {_m('score')} FROM escore UNION ALL SELECT re, 'compute_capacity', {_m('score')} FROM cscore WHERE score IS NOT NULL AND re IS NOT NULL UNION ALL SELECT entity_id, 'growth', {_m('score')} FROM gscore")
def measure_all(spark, sf_dir):
    return m.measure_all(figures(spark, sf_dir), YEAR).select("entity_id", "category", _micro("score"))


@Q.add(
    "capacity_cross_check",
    SI + """SELECT c.figure_id, cast(floor(max(e.si) / 1e6) AS bigint) AS energy_mj, coalesce(bool_or(false), false) OR coalesce(max(c.si) * 0.2::double * 31557600.0::double > 1e-2::double * max(e.si), false) AS flagged
FROM (SELECT * FROM picked WHERE metric_key = 'datacenter_capacity_operating') c
LEFT JOIN (SELECT * FROM si WHERE si > 0 AND metric_key = 'energy_consumption') e ON c.entity_id = e.entity_id AND (abs(c.year - e.year) <= 1 OR c.year IS NULL OR e.year IS NULL) GROUP BY c.figure_id""",
)
def capacity_cross_check(spark, sf_dir):
    f = figures(spark, sf_dir)
    capacity = m.picked(f).where("metric_key = 'datacenter_capacity_operating'")
    energy = f.where("si > 0 AND metric_key = 'energy_consumption'")
    got = m.capacity_conflicts(capacity, energy, factor=1e-2)
    return got.select("figure_id", F.floor(F.col("energy_j") / 1e6).cast("long").alias("energy_mj"), "flagged")


@Q.add("plausibility_bounds", SI + "SELECT metric_key, count(*) FILTER (si BETWEEN 1e9 AND 1e17) AS plausible, count(*) FILTER (si IS NULL) AS unreadable, count(*) AS n FROM si GROUP BY metric_key")
def plausibility_bounds(spark, sf_dir):
    si = F.col("si")
    return figures(spark, sf_dir).groupBy("metric_key").agg(F.count_if(si.between(1e9, 1e17)).alias("plausible"), F.count_if(si.isNull()).alias("unreadable"), F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = Q.functions, Q.sql
