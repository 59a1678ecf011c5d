"""URL filters: rules indexed by their rarest literal token; only candidate rules run regular expressions.

A rule has a regular expression over `host \\n path` (line feeds of a host count as blanks), the literal tokens (runs of ASCII letters and digits)
that every match must hold as whole tokens, a verdict and a rank. Token counts over all urls choose the
rarest token of each rule as its key; a url's tokens fetch the rules under those keys, and just those run
their expression. The fitting rule with the highest rank decides. Rules without a whole literal token are
candidates of every url, so they are held in the expression whatever the size of the rule set; they should be
few. Everything is a DataFrame expression or join; no Python runs on the executors.

Defined results: a null url, or one without `://`, has an empty host and path and gets the default; repeated
rows get a row each; of rules with one rank the greatest name wins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.llm.common import ascii_lower, pick, work_dir, written

#: Rules up to which the index is held in the expression (a few MB); beyond it the index is joined.
MAX_INLINE_RULES = 5000

RULE_SCHEMA = "rule string, host string, path string, pattern string, tokens array<string>, verdict string, rank int"

_TOKEN = "[A-Za-z0-9]+"
_ENTRY = "array<struct<rank:int,rule:string,verdict:string,pattern:string>>"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def prefix_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules: the host and its subdomains, paths that start so; longest wins.

    A path's last token is literal only if the rule goes on after it, as /en also fits /english.
    """
    df = spark.createDataFrame(rules, "verdict string, host string, path string").withColumn("host", ascii_lower(F.col("host")))
    whole = F.concat(F.col("host"), F.lit("\n"), F.col("path"))
    return df.select(
        F.concat("host", "path").alias("rule"),
        "host",
        "path",
        F.concat(F.lit(r"^(?:[^\n]*[.])?"), _quoted(whole)).alias("pattern"),
        F.array_distinct(F.concat(F.regexp_extract_all("host", F.lit(_TOKEN), F.lit(0)), F.regexp_extract_all("path", F.lit(f"{_TOKEN}(?=[^A-Za-z0-9])"), F.lit(0)))).alias("tokens"),
        "verdict",
        (F.length("host") + F.length("path")).alias("rank"),
    )


def pattern_rules(spark: SparkSession, rules: list[tuple[str, str, str, list[str]]]) -> DataFrame:
    """(name, verdict, regular expression over `host \\n path`, literal tokens) rules; they rank below prefixes."""
    df = spark.createDataFrame(rules, "rule string, verdict string, pattern string, tokens array<string>")
    return df.select("rule", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "pattern", "tokens", "verdict", F.lit(-1).alias("rank"))


def indexed(rules: DataFrame, urls: DataFrame, small: bool = False) -> DataFrame:
    """The rules with `token`: their rarest literal token over all urls(key), null if they have none.

    small: there are at most MAX_INLINE_RULES rules, so their tokens are broadcast and the urls' tokens are
    counted before any shuffle, however frequent one is.
    """
    tokens = rules.select(F.explode("tokens").alias("token")).distinct()
    tokens = F.broadcast(tokens) if small else tokens
    seen = urls.select(F.explode(F.array_distinct(F.regexp_extract_all("key", F.lit(_TOKEN), F.lit(0)))).alias("token"))
    counts = seen.join(tokens, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("*", F.explode_outer("tokens").alias("t")).join(counts, F.col("t") == F.col("token"), "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("t")))["t"].alias("token")
    return each.groupBy("rule", "verdict", "pattern", "rank").agg(best)


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """Per row of pages: id, host, path, rule (name of the deciding rule or null), verdict."""
    base = pick(pages, id_column, url_column).toDF("id", "url")
    base = base.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("key", F.concat(F.translate("host", "\n", " "), F.lit("\n"), "path"))
    small = rules.limit(MAX_INLINE_RULES + 1).count() <= MAX_INLINE_RULES
    rules = indexed(rules, base.select("key"), small)
    judged = _inline(base, rules.collect()) if small else _joined(base, rules)
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def _inline(base: DataFrame, rules: list) -> DataFrame:
    """`base` with `hit`: the index is a map in the expression; nothing is shuffled."""
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(r["token"] or "", []).append({k: r[k] for k in ("rank", "rule", "verdict", "pattern")})
    lookup = F.from_json(F.lit(json.dumps(index)), f"map<string,{_ENTRY}>")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("key", F.lit(_TOKEN), F.lit(0))))
    fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(lookup, t)), lambda c: c.isNotNull()))
    fits = F.filter("candidates", lambda c: F.regexp_like(F.col("key"), c["pattern"]))
    hits = F.transform(fits, lambda c: F.struct(c["rank"].alias("rank"), c["rule"].alias("rule"), c["verdict"].alias("verdict")))
    return base.withColumn("candidates", fetched).withColumn("hit", F.array_max(hits)).drop("candidates")


def _joined(base: DataFrame, rules: DataFrame) -> DataFrame:
    """Large rule sets: the tokens of distinct urls are joined with the index, so a hot url is judged once.

    Hits are a table of their own, so that adaptive execution can split a hot url in the join with them.
    """
    held = _inline(base, rules.where("token IS NULL").collect()).withColumnRenamed("hit", "held")
    urls = base.select("key").distinct()
    tokens = urls.select("key", F.explode(F.array_distinct(F.regexp_extract_all("key", F.lit(_TOKEN), F.lit(0)))).alias("token"))
    hits = tokens.join(rules.where("token IS NOT NULL"), "token").where(F.regexp_like(F.col("key"), F.col("pattern")))
    best = hits.groupBy("key").agg(F.max(F.struct("rank", "rule", "verdict")).alias("found"))
    best = written(best, work_dir(base.sparkSession, "url-hits"))
    both = held.join(best, "key", "left")
    return both.withColumn("hit", F.greatest("held", "found"))
