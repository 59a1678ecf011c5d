"""Queries over page views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.functions.url import host_of
from factweir.operators import traffic as t
from factweir.plans.query import Queries
from factweir.sources.derive import derived, with_sql

Q = Queries()
TODAY, START, DAYS = "2024-01-28", "2023-12-30", 30

VIEWS_SQL = (
    with_sql("page_views")
    + rf""",
v AS (SELECT event_id, ts, path, country_header, query, user_agent, accept, forwarded_for,
    cast(timezone('America/Los_Angeles', timezone('UTC', ts)) AS date) AS day,
    regexp_replace(lower(regexp_extract(coalesce(referer, ''), '://([^/?#:]*)', 1)), '^www\.', '') AS h FROM page_views
  WHERE status BETWEEN 200 AND 299 AND NOT regexp_matches(path, '^(/static|/health|/admin|/internal|/robots\.txt|/sitemap\.xml|/favicon|/apple-touch-icon)')),
views AS (SELECT event_id, ts, day, left(path, 200) AS path, CASE WHEN h = '' THEN 'direct' WHEN h = 'site1.example' THEN 'internal' ELSE left(h, 120) END AS ref,
    CASE WHEN regexp_matches(upper(trim(country_header)), '^[A-Z][A-Z0-9]$') THEN upper(trim(country_header)) END AS country,
    nullif(left(lower(trim(regexp_extract(query, '(^|&)utm_source=([^&]*)', 2))), 64), '') AS utm_source,
    CASE WHEN trim(user_agent) = '' THEN 'bot' WHEN regexp_matches(user_agent, '(?i){t.MONITOR_PATTERN}') THEN 'monitor'
      WHEN regexp_matches(user_agent, '(?i){t.BOT_PATTERN}') THEN 'bot'
      WHEN accept <> '' AND NOT contains(accept, 'text/html') AND NOT contains(accept, '*/*') THEN 'monitor' ELSE 'human' END AS ua_class,
    left(sha256('salt-' || cast(day AS varchar) || trim(split_part(forwarded_for, ',', 1)) || chr(1) || user_agent), 16) AS visitor FROM v),
long AS (SELECT day, ua_class, visitor, 'total' AS dim, '' AS key FROM views UNION ALL SELECT day, ua_class, visitor, 'path', path FROM views
  UNION ALL SELECT day, ua_class, visitor, 'ref', coalesce(ref, 'direct') FROM views UNION ALL SELECT day, ua_class, visitor, 'country', coalesce(country, '??') FROM views
  UNION ALL SELECT day, ua_class, visitor, 'utm_source', utm_source FROM views WHERE utm_source IS NOT NULL),
rolled AS (SELECT day, dim, left(key, 200) AS key, ua_class, count(*) AS views, count(DISTINCT visitor) AS visitors FROM long GROUP BY ALL)
"""
)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.classify_views(derived(spark, sf_dir, "page_views"))


def _day(d: str) -> F.Column:
    return F.lit(d).cast("date")


def _text(df: DataFrame) -> DataFrame:
    """Days as text, which every reader shows alike."""
    return df.withColumn("day", F.col("day").cast("string"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that has rolled up the even days, and the other days live."""
    v = views(spark, sf_dir)
    stored = t.rollup(v.where("day(day) % 2 = 0"))
    return t.daily(stored, v, _day(START), _day(TODAY)).where(F.col("day") <= _day(TODAY))


_LIVE = f"{VIEWS_SQL}, r AS (SELECT * FROM rolled WHERE day >= DATE '{START}' AND day <= DATE '{TODAY}')"


@Q.add("page_view_capture", VIEWS_SQL + "SELECT event_id, cast(day AS varchar) AS day, path, ref, country, utm_source, ua_class, visitor FROM views")
def page_view_capture(spark, sf_dir):
    return _text(views(spark, sf_dir).drop("ts"))


@Q.add("traffic_rollup", VIEWS_SQL + "SELECT * REPLACE (cast(day AS varchar) AS day) FROM rolled")
def traffic_rollup(spark, sf_dir):
    return _text(t.rollup(views(spark, sf_dir)))


@Q.add("traffic_live_union", _LIVE + "SELECT * REPLACE (cast(day AS varchar) AS day) FROM r")
def traffic_live_union(spark, sf_dir):
    return _text(_rows(spark, sf_dir))


@Q.add(
    "traffic_series",
    _LIVE
    + f""", c AS (SELECT cast(d AS date) AS day FROM generate_series(DATE '{START}', DATE '{TODAY}', INTERVAL 1 DAY) s(d)),
s AS (SELECT c.day, coalesce(sum(visitors), 0) AS visitors, coalesce(sum(views), 0) AS views FROM c LEFT JOIN (SELECT * FROM r WHERE dim = 'total' AND ua_class = 'human') r USING (day) GROUP BY c.day)
SELECT cast(cast(day AS date) AS varchar) AS day, cast(visitors AS bigint) AS visitors, cast(views AS bigint) AS views,
  cast(floor(100 * visitors / coalesce(nullif(max(visitors) OVER (), 0), 1) + 0.5) AS bigint) AS pct,
  cast(coalesce(sum(visitors) OVER w, 0) AS bigint) AS sum7, count(*) OVER w AS n7 FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def traffic_series(spark, sf_dir):
    return _text(t.series(_rows(spark, sf_dir), _day(START), DAYS))


@Q.add(
    "traffic_top_keys",
    _LIVE
    + """, k AS (SELECT dim, key, sum(views) AS views FROM r WHERE ua_class = 'human' AND dim <> 'total' GROUP BY dim, key),
p AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY views DESC, key) AS n FROM k),
s AS (SELECT dim, key, views, row_number() OVER (PARTITION BY dim ORDER BY views DESC, key) AS place FROM p
  WHERE n <= CASE WHEN dim = 'country' THEN 11 ELSE 10 END AND NOT (dim = 'country' AND key = '??'))
SELECT dim, key, cast(views AS bigint) AS views, place FROM s WHERE place <= 10""",
)
def traffic_top_keys(spark, sf_dir):
    return t.top_keys(_rows(spark, sf_dir))


@Q.add(
    "traffic_class_share",
    _LIVE + "SELECT ua_class, cast(sum(views) AS bigint) AS views, cast(floor(1000 * sum(views) / sum(sum(views)) OVER () + 0.5) AS bigint) AS permille FROM r WHERE dim = 'total' GROUP BY ua_class",
)
def traffic_class_share(spark, sf_dir):
    return t.class_share(_rows(spark, sf_dir))


@Q.add("traffic_retention", VIEWS_SQL + f"SELECT cast(day AS varchar) AS day, count(*) AS n FROM views WHERE day >= DATE '{TODAY}' - 10 GROUP BY day")
def traffic_retention(spark, sf_dir):
    return _text(t.retained(views(spark, sf_dir), _day(TODAY), 10).groupBy("day").agg(F.count(F.lit(1)).alias("n")))


@Q.add("traffic_days", VIEWS_SQL + "SELECT DISTINCT cast(day AS varchar) AS day FROM views")
def traffic_days(spark, sf_dir):
    return _text(views(spark, sf_dir).select("day").distinct())


@Q.add(
    "pacific_bounds",
    """SELECT event_id, timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', ts))))) AS day_start,
 timezone('UTC', timezone('America/Los_Angeles', date_trunc('month', timezone('America/Los_Angeles', timezone('UTC', ts))))) AS month_start FROM events""",
)
def pacific_bounds(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), t.PACIFIC)
    back = lambda unit: F.to_utc_timestamp(F.date_trunc(unit, local), t.PACIFIC).cast("timestamp_ntz")
    from factweir.tables import table

    return table(spark, sf_dir, "events").select("event_id", back("day").alias("day_start"), back("month").alias("month_start"))


@Q.add("referrer_hosts", with_sql("page_views") + r"SELECT regexp_replace(lower(regexp_extract(coalesce(referer, ''), '://([^/?#:]*)', 1)), '^www\.', '') AS host, count(*) AS n FROM page_views GROUP BY 1")
def referrer_hosts(spark, sf_dir):
    return derived(spark, sf_dir, "page_views").groupBy(host_of(F.col("referer")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = Q.functions, Q.sql
