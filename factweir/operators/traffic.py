"""Page views: classification, daily rollup by dimension, report and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.functions.url import host_of

PACIFIC = "America/Los_Angeles"
DIMENSIONS = ("total", "path", "ref", "country", "utm_source")
CLASSES = ("human", "bot", "monitor")

#: Prefixes of paths that are not counted.
SKIPPED_PATHS = ("/static", "/health", "/admin", "/internal", "/robots.txt", "/sitemap.xml", "/favicon", "/apple-touch-icon")

#: User agents of crawlers and of uptime monitors.
BOT_PATTERN = (
    "bot|crawl|spider|slurp|facebookexternalhit|embedly|preview|scrape|curl|wget|python-requests|"
    "python-urllib|httpx|aiohttp|go-http-client|java/|okhttp|libwww|headless|phantom|axios|node-fetch"
)
MONITOR_PATTERN = "uptime|pingdom|statuscake|betteruptime|better stack|site24x7|checkly|render/|monitor|healthcheck|newrelic|datadog"


def pacific_day(ts: Column) -> Column:
    """Calendar day in Pacific time of a UTC timestamp without zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), PACIFIC))


def agent_class(agent: Column, accept: Column) -> Column:
    """Monitors are told before bots; clients that don't take HTML count as monitors."""
    ua, accept = F.trim(F.coalesce(agent, F.lit(""))), F.coalesce(accept, F.lit(""))
    takes_html = (accept == "") | accept.contains("text/html") | accept.contains("*/*")
    return F.when(ua == "", "bot").when(ua.rlike(f"(?i){MONITOR_PATTERN}"), "monitor").when(ua.rlike(f"(?i){BOT_PATTERN}"), "bot").when(~takes_html, "monitor").otherwise("human")


def referrer(referer: Column, own_host: str) -> Column:
    """direct, internal, or the host up to 120 characters."""
    host = host_of(referer)
    return F.when(host == "", "direct").when(host == own_host.lower().split(":")[0].removeprefix("www."), "internal").otherwise(F.left(host, F.lit(120)))


def parameter(query: Column, name: str) -> Column:
    """First value of a query parameter, trimmed, lower-cased, up to 64 characters; null if empty."""
    value = F.try_url_decode(F.regexp_extract(F.coalesce(query, F.lit("")), f"(?:^|&){name}=([^&]*)", 1))
    return F.nullif(F.left(F.lower(F.trim(value)), F.lit(64)), F.lit(""))


def country_code(header: Column) -> Column:
    code = F.upper(F.trim(header))
    return F.when(code.rlike("^[A-Z][A-Z0-9]$"), code)


def visitor(day: Column, client: Column, agent: Column, salt: Column | None = None) -> Column:
    """Sixteen hex digits that identify a client for one day; `salt` should be random for each day."""
    salt = F.concat(F.lit("salt-"), day.cast("string")) if salt is None else salt
    return F.left(F.sha2(F.concat(salt, client, F.lit("\u0001"), F.coalesce(agent, F.lit(""))), 256), F.lit(16))


def classify_views(requests: DataFrame, own_host: str = "site1.example") -> DataFrame:
    """Requests that count as page views, with the columns of the rollup. Works on streams as well."""
    counted = requests.where(~F.col("path").rlike("^(" + "|".join(p.replace(".", "[.]") for p in SKIPPED_PATHS) + ")") & F.col("status").between(200, 299))
    day = pacific_day(F.col("ts"))
    return counted.select(
        "event_id",
        "ts",
        day.alias("day"),
        F.left("path", F.lit(200)).alias("path"),
        referrer(F.col("referer"), own_host).alias("ref"),
        country_code(F.col("country_header")).alias("country"),
        parameter(F.col("query"), "utm_source").alias("utm_source"),
        agent_class(F.col("user_agent"), F.col("accept")).alias("ua_class"),
        visitor(day, F.trim(F.split_part("forwarded_for", F.lit(","), F.lit(1))), F.col("user_agent")).alias("visitor"),
    )


def rollup(views: DataFrame) -> DataFrame:
    """Views and distinct visitors by day, dimension, key and agent class, in one pass over the views."""
    pairs = F.array(
        F.struct(F.lit("total").alias("dim"), F.lit("").alias("key")),
        F.struct(F.lit("path").alias("dim"), F.col("path").alias("key")),
        F.struct(F.lit("ref").alias("dim"), F.coalesce("ref", F.lit("direct")).alias("key")),
        F.struct(F.lit("country").alias("dim"), F.coalesce("country", F.lit("??")).alias("key")),
        F.struct(F.lit("utm_source").alias("dim"), F.col("utm_source").alias("key")),
    )
    each = views.select("day", "ua_class", "visitor", F.explode(pairs).alias("p")).where("p.dim <> 'utm_source' OR p.key <> ''")
    return each.groupBy("day", F.col("p.dim").alias("dim"), F.left("p.key", F.lit(200)).alias("key"), "ua_class").agg(F.count(F.lit(1)).alias("views"), F.count_distinct("visitor").alias("visitors"))


def daily(rolled: DataFrame, views: DataFrame, start: Column, today: Column) -> DataFrame:
    """Rollup rows from `start` on: stored days before today, and the others straight from the views."""
    stored = rolled.where((F.col("day") >= start) & (F.col("day") < today))
    live = views.where(F.col("day") >= start).join(stored.select("day").distinct(), "day", "left_anti")
    return stored.unionByName(rollup(live))


def series(rows: DataFrame, start: Column, days: int, classes: tuple[str, ...] = ("human",)) -> DataFrame:
    """One row for each of `days` days: visitors, views, percent of the peak, mean of the 7 days before."""
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("day"))
    totals = rows.where(F.col("dim") == "total").where(F.col("ua_class").isin(*classes)).groupBy("day").agg(F.sum("visitors").alias("visitors"), F.sum("views").alias("views"))
    full = calendar.join(totals, "day", "left").fillna(0, ["visitors", "views"])
    peak = F.max("visitors").over(Window.partitionBy())  # as many rows as days were asked for
    before = Window.partitionBy().orderBy("day").rowsBetween(-7, -1)
    pct = F.floor(F.lit(100) * F.col("visitors") / F.coalesce(F.nullif(peak, F.lit(0)), F.lit(1)) + 0.5).cast("long")
    return full.select("day", "visitors", "views", pct.alias("pct"), F.coalesce(F.sum("visitors").over(before), F.lit(0)).alias("sum7"), F.count("visitors").over(before).alias("n7"))


def top_keys(rows: DataFrame, classes: tuple[str, ...] = ("human",), n: int = 10) -> DataFrame:
    """The n most viewed keys of each dimension, ties by key; unknown countries take a place, then go."""
    counts = rows.where(F.col("ua_class").isin(*classes) & (F.col("dim") != "total")).groupBy("dim", "key").agg(F.sum("views").alias("views"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("views"), "key"))
    room = F.when(F.col("dim") == "country", n + 1).otherwise(n)
    known = counts.withColumn("place", place).where(F.col("place") <= room).where("NOT (dim = 'country' AND key = '??')")
    again = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("views"), "key"))
    return known.withColumn("place", again).where(F.col("place") <= n).select("dim", "key", "views", "place")


def class_share(rows: DataFrame) -> DataFrame:
    """Views of each agent class and its permille of all."""
    got = rows.where("dim = 'total'").groupBy("ua_class").agg(F.sum("views").alias("views"))
    total = F.sum("views").over(Window.partitionBy())  # three rows
    return got.select("ua_class", "views", F.floor(F.lit(1000) * F.col("views") / F.nullif(total, F.lit(0)) + 0.5).cast("long").alias("permille"))


def write_rollup(views: DataFrame, path: str, today: Column) -> None:
    """Replaces the finished days that the views hold, day by day; running it again changes nothing."""
    done = rollup(views.where(F.col("day") < today))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def retained(views: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Views that are young enough to stay."""
    return views.where(F.col("day") >= F.date_sub(today, days))
