"""Queries over sources, pages and quotes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.functions import figures, kernels, text, url
from factweir.functions import patterns as p
from factweir.operators import evidence as e
from factweir.plans.figure_queries import CHUNKS, SCORED
from factweir.plans.query import Queries
from factweir.shipping import ship
from factweir.sources.derive import derived, with_sql
from factweir.tables import table

Q = Queries()
DOCS = with_sql("source_docs")

_NORMAL = rf"""lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(trim(url), '://([^/?#]*)', 1))
  || CASE WHEN regexp_replace(regexp_extract(trim(url), '://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(trim(url), '://[^/?#]*([^?#]*)', 1), '/+$', '') END
  || regexp_extract(trim(url), '(\?[^#]*)', 1)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "source_docs")


@Q.add("source_unique_urls", DOCS + f"SELECT run_id, {_NORMAL} AS normal_url, min(source_id) AS source_id FROM source_docs GROUP BY 1, 2")
def source_unique_urls(spark, sf_dir):
    return e.unique_urls(_sources(spark, sf_dir))


@Q.add("source_duplicates", DOCS + "SELECT run_id, source_id, sha256(text) AS sha, CASE WHEN min(source_id) OVER (PARTITION BY run_id, sha256(text)) < source_id THEN min(source_id) OVER (PARTITION BY run_id, sha256(text)) ELSE -1 END AS duplicate_of FROM source_docs")
def source_duplicates(spark, sf_dir):
    return e.mark_duplicates(_sources(spark, sf_dir)).fillna(-1, ["duplicate_of"])


@Q.add(
    "quote_verification",
    r"""WITH q AS (SELECT item_id AS quote_id, 0 AS run_id, item_id AS source_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS sk, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM benchmark),
s AS (SELECT doc_id AS found_in, 0 AS run_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS tsk, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS tnorm FROM documents)
SELECT quote_id, found_in, method FROM (SELECT quote_id, found_in, CASE WHEN contains(tnorm, norm) THEN 'exact' ELSE 'loose' END AS method,
  row_number() OVER (PARTITION BY quote_id ORDER BY found_in <> source_id, found_in) AS n FROM q JOIN s USING (run_id)
  WHERE length(norm) BETWEEN 20 AND 600 AND length(sk) >= 14 AND contains(tsk, sk)) WHERE n = 1""",
)
def quote_verification(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.lit(0).alias("run_id"), F.col("item_id").alias("source_id"), F.col("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("run_id"), F.col("doc_id").alias("source_id"), "text")
    return e.verify_quotes(quotes, docs)


@Q.add(
    "quote_search",
    r"""WITH q AS (SELECT item_id AS quote_id, item_id AS source_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS sk, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM benchmark),
s AS (SELECT doc_id AS found_in, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS tsk, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS tnorm FROM documents)
SELECT quote_id, found_in, method FROM (SELECT quote_id, found_in, CASE WHEN contains(tnorm, norm) THEN 'exact' ELSE 'loose' END AS method,
  row_number() OVER (PARTITION BY quote_id ORDER BY found_in <> source_id, found_in) AS n FROM q CROSS JOIN s
  WHERE length(norm) BETWEEN 20 AND 600 AND length(sk) >= 14 AND contains(tsk, sk)) WHERE n = 1""",
)
def quote_search(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("item_id").alias("source_id"), F.col("text").alias("quote"))
    return e.find_quotes(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@Q.add("page_status", DOCS + rf"""SELECT source_id, CASE WHEN starts_with(coalesce(error, ''), 'blocked') THEN 'blocked' WHEN http_status IS NULL OR http_status <> 200 THEN 'dead'
  WHEN length(text) < 2000 AND regexp_matches(left(text, 400), '(?i){text.NOT_FOUND.replace("'", "''")}') THEN 'soft_404' WHEN length(text) < 300 THEN 'thin' ELSE 'ok' END AS status FROM source_docs""")
def page_status(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_id", text.page_status(F.col("error"), F.col("http_status"), F.col("text"), F.lit(None).cast("string")).alias("status"))


@Q.add("host_failures", DOCS + r"""SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host, count(*) AS total, count(*) FILTER (http_status IS DISTINCT FROM 200) AS failed, count(*) FILTER (http_status = 404) AS dead
FROM source_docs GROUP BY 1 HAVING failed > 0 ORDER BY failed DESC, host LIMIT 10""")
def host_failures(spark, sf_dir):
    http = F.col("http_status")
    return e.host_failures(_sources(spark, sf_dir), F.when(http == 200, "ok").when(http == 404, "dead").otherwise("error"))


@Q.add("normal_text", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')))) AS normal, md5(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))) AS squashed, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS skeleton FROM documents")
def normal_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normal_text(t)).alias("normal"), F.md5(text.squash(t)).alias("squashed"), F.md5(text.skeleton(t)).alias("skeleton"))


@Q.add("company_names", rf"SELECT c_custkey, trim(regexp_replace(regexp_replace(replace(lower(c_name || ' Holdings & Co.'), '&', ' and '), '\b({text.LEGAL_FORMS})\b[.]?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS core, replace(lower(c_name || ' AG'), ' ', '-') AS slug, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_ \t]', '', 'g'), '[ \t]+', ' ', 'g')) AS plain FROM customer")
def company_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.core_name(F.concat("c_name", F.lit(" Holdings & Co."))).alias("core"), text.slug(F.concat("c_name", F.lit(" AG"))).alias("slug"), text.dedup_name(F.col("c_name")).alias("plain"))


@Q.add("text_scores", rf"""WITH c AS (SELECT doc_id, text AS t FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(t, '(?i){p.QUANT}')) AS q, len(regexp_extract_all(t, '(?i){p.UNIT_NUMBER}')) AS u, len(regexp_extract_all(t, '{p.LARGE_NUMBER}')) AS b,
  len(list_distinct(list_transform(regexp_extract_all(t, '(?i){p.QUAL}'), lambda x: lower(x)))) AS w, least(4.0::double * len(regexp_extract_all(t, '(?i){p.BOILERPLATE}')), 12) AS boiler FROM c)
SELECT doc_id, cast((4 * q + 6 * u + CASE WHEN q + u > 0 THEN 0.75::double * least(b, 12) ELSE 0 END - boiler) * 100 AS bigint) AS quant, cast(least(w, 10) - boiler AS bigint) AS qual FROM n""")
def text_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.chunk_scores(F.col("text")).alias("s"))
    return d.select("doc_id", (F.col("s.quant") * 100).cast("long").alias("quant"), F.col("s.qual").cast("long").alias("qual"))


@Q.add("chunk_plan", CHUNKS + SCORED + 'SELECT doc_id AS source_id, i, s AS "start", e AS "end", quant, qual FROM sc')
def chunk_plan(spark, sf_dir):
    long = {c: F.col(c).cast("long") for c in ("start", "end")}
    return e.ranked_chunks(_sources(spark, sf_dir)).withColumns({**long, "quant": F.col("quant").cast("double"), "qual": F.col("qual").cast("double")})


@Q.add("excerpt_budget")
def excerpt_budget(spark, sf_dir):
    longer = e.ranked_chunks(_sources(spark, sf_dir)).withColumn("score", F.col("qual") + F.lit(1.0) / (F.col("i") + 2))
    return e.take_within(longer, "score", 2500)


@Q.add("number_match", r"""WITH n AS (SELECT l_orderkey, l_partkey, l_extendedprice AS v, 'about ' || cast(cast(floor(l_extendedprice) AS bigint) AS varchar) || ' or ' || cast(l_partkey AS varchar) || ',500 units' AS t FROM lineitem),
p AS (SELECT *, list_transform(regexp_extract_all(t, '[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?'), lambda x: cast(replace(x, ',', '') AS double)) AS xs FROM n)
SELECT l_orderkey, l_partkey, len(xs) AS n, len(list_filter(xs, lambda x: x = v OR (x <> 0 AND abs(v - x) <= abs(x) * 0.005::double))) > 0 AS hit FROM p""")
def number_match(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = F.concat(F.lit("about "), F.floor("l_extendedprice").cast("long").cast("string"), F.lit(" or "), F.col("l_partkey").cast("string"), F.lit(",500 units"))
    p = li.select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("v"), text.plain_numbers(t).alias("xs"))
    return p.select("l_orderkey", "l_partkey", F.size("xs").cast("long").alias("n"), text.number_matches(F.col("xs"), F.col("v")).alias("hit"))


@Q.add("html_pages", r"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS body,
  len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS n_links FROM b""")
def html_pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(h).alias("title"), F.md5(text.html_text(h)).alias("body"), F.size(text.html_links(h)).cast("long").alias("n_links"))


@Q.add("url_admission", r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND regexp_extract(url, '://([^/?#:]*)', 1) <> '' AS allowed,
  regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host, regexp_matches(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '(^|\.)example\.com$') AS own,
  coalesce(nullif(left(lower(trim(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1))), 64), ''), '') AS utm FROM pages""")
def url_admission(spark, sf_dir):
    u = F.col("url")
    from factweir.operators.traffic import parameter

    utm = F.coalesce(parameter(F.regexp_extract(u, r"\?([^#]*)", 1), "utm_source"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", url.allowed_url(u).alias("allowed"), url.host_of(u).alias("host"), url.under(url.host_of(u), F.lit("example.com")).alias("own"), utm.alias("utm"))


@Q.add("similar_names")
def similar_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return e.similar_names(names.withColumn("name", F.concat("name", F.lit(" Inc."))), names)


@Q.add("name_similarity")
def name_similarity(spark, sf_dir):
    ship(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", text.core_name(F.col("s_name")).alias("a"))
    return s.withColumn("b", F.concat("a", F.lit(" energy"))).select("s_suppkey", kernels.indel_ratio("a", "b").alias("indel"), kernels.token_set_ratio("a", "b").alias("token_set"), F.size(kernels.numbers_in(F.concat("a", F.lit(" 1,053 and 4.2 billion")))).alias("n_numbers"))


@Q.add("candidate_rank", DOCS + r"""SELECT run_id, source_id, place FROM (SELECT run_id, source_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN origin = 'research' THEN 2 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)/a[1-3]/') THEN 3 ELSE 0 END DESC, source_id) AS place FROM source_docs) WHERE place <= 12""")
def candidate_rank(spark, sf_dir):
    priority = F.when(F.col("origin") == "research", 2).otherwise(0) + F.when(F.col("url").rlike("(?i)/a[1-3]/"), 3).otherwise(0)
    return e.first_candidates(_sources(spark, sf_dir), priority).select("run_id", "source_id", "place")


@Q.add("defer_decision", DOCS + "SELECT run_id, bool_and(http_status IS NULL OR http_status = 503) AS all_transient, bool_or(http_status = 200) AS any_read, count(*) FILTER (origin = 'edgar') AS filings FROM source_docs GROUP BY run_id")
def defer_decision(spark, sf_dir):
    http = F.col("http_status")
    return e.deferral(_sources(spark, sf_dir), http.isNull() | (http == 503), http == 200)


@Q.add("page_scan", r"""WITH p AS (SELECT conv_id AS doc_id, turn AS page, max(turn) OVER (PARTITION BY conv_id) + 1 AS n, turn = 1 AS o, text FROM conversations),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN o THEN 0 WHEN page >= floor(n * 0.6) THEN 1 ELSE 2 END, CASE WHEN page >= floor(n * 0.6) AND NOT o THEN -page ELSE page END) AS ord, regexp_matches(text, 'and|der|les') AS hit FROM p),
h AS (SELECT *, max(ord) FILTER (hit) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g WHERE ord <= 120),
s AS (SELECT *, min(ord) FILTER (ord - last > 1) OVER (PARTITION BY doc_id) AS stop FROM h)
SELECT doc_id, page, nth FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM s WHERE hit AND (stop IS NULL OR ord < stop)) WHERE nth <= 3""")
def page_scan(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("n_pages"))
    pages = c.join(n, "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "n_pages", (F.col("turn") == 1).alias("in_outline"), "text")
    return e.page_order(pages, "and|der|les", keep=3, quiet=1)


QUERIES, ORACLE = Q.functions, Q.sql
