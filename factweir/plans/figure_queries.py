"""Queries over quotes, figures and excerpts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweir.functions import figures as fg
from factweir.functions import patterns as p
from factweir.functions import text
from factweir.operators import evidence as e
from factweir.operators import excerpts as x
from factweir.operators import measures as m
from factweir.operators import quotes as qt
from factweir.plans.query import Queries
from factweir.shipping import ship_for_texts
from factweir.sources.derive import derived, with_sql
from factweir.tables import table

Q = Queries()

CHUNKS = r"""WITH RECURSIVE c(doc_id, i, t, s, e) AS (
  SELECT doc_id, 0, text, 0::bigint, CASE WHEN length(text) <= 1100 THEN length(text) WHEN contains(substr(text, 551, 550), ' ') THEN 1100 - strpos(reverse(substr(text, 551, 550)), ' ') ELSE 1100 END FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, i + 1, t, b, CASE WHEN b + 1100 >= length(t) THEN length(t) WHEN contains(substr(t, b + 551, 550), ' ') THEN b + 1100 - strpos(reverse(substr(t, b + 551, 550)), ' ') ELSE b + 1100 END
  FROM (SELECT *, e + length(substr(t, e + 1, 1200)) - length(ltrim(substr(t, e + 1, 1200), ' ')) AS b FROM c WHERE e < length(t)) WHERE b < length(t))
"""
SCORED = rf""", n AS (SELECT doc_id, i, s, e, len(regexp_extract_all(b, '(?i){p.QUANT}')) AS q, len(regexp_extract_all(b, '(?i){p.UNIT_NUMBER}')) AS u, len(regexp_extract_all(b, '{p.LARGE_NUMBER}')) AS big,
  len(list_distinct(list_transform(regexp_extract_all(b, '(?i){p.QUAL}'), lambda w: lower(w)))) AS w, least(4.0::double * len(regexp_extract_all(b, '(?i){p.BOILERPLATE}')), 12) AS boiler FROM (SELECT *, substr(t, s + 1, e - s) AS b FROM c)),
sc AS (SELECT doc_id, i, s, e, 4 * q + 6 * u + CASE WHEN q + u > 0 THEN 0.75::double * least(big, 12) ELSE 0 END - boiler AS quant, least(w, 10) - boiler AS qual FROM n)
"""


def _chunks(spark, sf_dir):
    return e.ranked_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@Q.add("chunk_scores", CHUNKS + SCORED + 'SELECT doc_id, i, s AS "start", e AS "end", cast(quant * 100 AS bigint) AS quant, cast(qual AS bigint) AS qual FROM sc')
def chunk_scores(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select(F.col("source_id").alias("doc_id"), "i", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("quant") * 100).cast("long").alias("quant"), F.col("qual").cast("long").alias("qual"))


@Q.add("chunk_relevance", CHUNKS + SCORED + """, a AS (SELECT doc_id, quant, qual, row_number() OVER (PARTITION BY doc_id ORDER BY quant DESC) AS nq, row_number() OVER (PARTITION BY doc_id ORDER BY qual DESC) AS nl FROM sc)
SELECT doc_id, cast(coalesce(sum(quant) FILTER (nq <= 8 AND quant > 0), 0) * 100 AS bigint) + 200 * cast(coalesce(sum(qual) FILTER (nl <= 8 AND qual > 0), 0) AS bigint) AS relevance FROM a GROUP BY doc_id""")
def chunk_relevance(spark, sf_dir):
    return e.relevance(_chunks(spark, sf_dir)).select(F.col("source_id").alias("doc_id"), (F.col("relevance") * 100).cast("long").alias("relevance"))


def _worth(body):
    """Scores that invented prose has too: its numbers, and its distinct long words."""
    words = F.array_distinct(F.regexp_extract_all(body, F.lit("[a-z]{10,}"), F.lit(0)))
    return F.struct(F.regexp_count(body, F.lit("[0-9]+")).cast("double").alias("quant"), F.least(F.size(words), F.lit(10)).cast("double").alias("qual"))


_WORTH = ", sc AS (SELECT doc_id, len(regexp_extract_all(b, '[0-9]+'))::double AS quant, least(len(list_distinct(regexp_extract_all(b, '[a-z]{10,}'))), 10)::double AS qual FROM (SELECT doc_id, substr(t, s + 1, e - s) AS b FROM c))"


@Q.add("source_excerpts")
def source_excerpts(spark, sf_dir):
    """What a reader of 6000 characters for each document gets."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("source_id"), "text")
    wanted = docs.select("source_id", F.length("text").alias("length"), F.lit(6000).alias("budget"))
    return x.choose(e.ranked_chunks(docs, x.chunk_size(6000), _worth), wanted)


@Q.add("excerpt_retry")
def excerpt_retry(spark, sf_dir):
    """A second choice of small chunks for documents of which a first one of 1000 characters gave nothing."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("source_id"), "text")
    wanted = docs.select("source_id", F.length("text").alias("length"), F.lit(1000).alias("budget"))
    chunks = e.ranked_chunks(docs, x.chunk_size(1000), _worth)
    return x.choose(chunks, wanted, x.choose(chunks, wanted))


_RUN_SOURCES = r"""WITH s AS (SELECT doc_id // 25 AS run_id, doc_id AS source_id, length(coalesce(text, '')) AS length,
  CASE doc_id % 7 WHEN 0 THEN 'https://www.sec.gov/a' WHEN 1 THEN 'https://x.com/Archives/000000000124000001/acme-20231231.htm' ELSE 'https://x.com/news' END AS url, CASE WHEN doc_id % 11 = 0 THEN 'filing' ELSE 'research' END AS origin FROM documents WHERE doc_id IS NOT NULL)"""


def _run_sources(spark, sf_dir):
    """Documents as sources of runs of 25, some of them filings by address or origin."""
    i = F.col("doc_id")
    link = F.when(i % 7 == 0, "https://www.sec.gov/a").when(i % 7 == 1, "https://x.com/Archives/000000000124000001/acme-20231231.htm").otherwise("https://x.com/news")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return docs.select(F.floor(i / 25).alias("run_id"), i.alias("source_id"), F.length(F.coalesce("text", F.lit(""))).alias("length"), link.alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("title"), F.when(i % 11 == 0, "filing").otherwise("research").alias("origin"), "text")


@Q.add("budget_shares", CHUNKS + _WORTH + """, a AS (SELECT doc_id, quant, qual, row_number() OVER (PARTITION BY doc_id ORDER BY quant DESC) AS nq, row_number() OVER (PARTITION BY doc_id ORDER BY qual DESC) AS nl FROM sc),
r AS (SELECT doc_id, coalesce(sum(qual) FILTER (nl <= 8 AND qual > 0), 0) AS ql, coalesce(sum(quant) FILTER (nq <= 8 AND quant > 0), 0) + 2 * coalesce(sum(qual) FILTER (nl <= 8 AND qual > 0), 0) AS rel FROM a GROUP BY doc_id),
""" + _RUN_SOURCES.removeprefix("WITH ") + r""",
k AS (SELECT s.run_id, s.source_id, s.length, coalesce(r.ql, 0) AS ql, least(greatest(coalesce(r.rel, 0), 0), 300)::double AS rel, url LIKE 'https://www.sec.gov/%' OR origin = 'filing' OR url LIKE '%acme-20231231.htm' AS filing FROM s LEFT JOIN r ON r.doc_id = s.source_id),
t AS (SELECT *, least(length, CASE WHEN filing THEN 8000 ELSE 20000 END) AS most, NOT filing AND ql > 0 AND row_number() OVER (PARTITION BY run_id, NOT filing AND ql > 0 ORDER BY ql DESC, source_id) <= 3 AS best FROM k),
f AS (SELECT *, least(most, CASE WHEN best THEN 6000 ELSE 2500 END) AS base, most - least(most, CASE WHEN best THEN 6000 ELSE 2500 END) AS room, CASE WHEN rel > 0 THEN sqrt(rel) ELSE 1 END AS w, rel > 0 AS g FROM t),
l AS (SELECT run_id, greatest(64000 - sum(base), 0) AS pot, coalesce(sum(room) FILTER (g), 0) AS wet FROM f GROUP BY run_id),
pots AS (SELECT f.*, CASE WHEN g THEN pot ELSE greatest(pot - wet, 0) END AS pot FROM f JOIN l USING (run_id)),
v AS (SELECT a.run_id, a.g, a.source_id, max(a.pot) AS pot, sum(least(b.room, b.w * (a.room / a.w))) AS held FROM pots a JOIN pots b ON a.run_id = b.run_id AND a.g = b.g GROUP BY a.run_id, a.g, a.source_id, a.room, a.w),
full_ AS (SELECT pots.*, v.held <= pots.pot + 1e-6 AS filled FROM pots JOIN v USING (run_id, g, source_id)),
lvl AS (SELECT run_id, g, (max(pot) - coalesce(sum(room) FILTER (filled), 0)) / nullif(sum(w) FILTER (NOT filled), 0) AS level FROM full_ GROUP BY run_id, g)
SELECT run_id, source_id, cast(base + CASE WHEN filled THEN room ELSE least(room, floor(level * w + 1e-6)) END AS bigint) AS budget FROM full_ JOIN lvl USING (run_id, g)""")
def budget_shares(spark, sf_dir):
    s = _run_sources(spark, sf_dir)
    chunks = e.ranked_chunks(s.select("source_id", "text"), scores=_worth)
    s = s.drop("text").join(e.relevance(chunks), "source_id", "left").withColumn("qual", F.coalesce("qual", F.lit(0.0)))
    return x.allocate(x.source_kinds(s), total=64_000, per_source=20_000, filing_most=8000, qual_floor=6000)


@Q.add("claims_followup")
def claims_followup(spark, sf_dir):
    """Passages that are read again for claims in runs with too few, over whole documents."""
    s = _run_sources(spark, sf_dir)
    runs = s.groupBy("run_id").agg((F.min("source_id") % 5).alias("claims_verified"), (F.min("source_id") % 40 / 100).alias("cost"))
    kinds = x.source_kinds(s.drop("text").withColumn("qual", F.lit(0.0)))
    return x.claim_passages(e.ranked_chunks(s.select("source_id", "text"), scores=_worth), kinds, x.needs_claims(runs))


_METRICS = ("energy_consumption", "electricity_consumption", "energy_generated", "energy_supplied", "datacenter_capacity_operating", "capex", "revenue")
_QUOTES = (
    "we consumed 12,000 MWh of energy", "energy sold and delivered to customers", "megapack storage systems reached 3 GWh", "plants generated power in total", "capital expenditures of note",
    "senior notes raised for the year", "a capacity of 120 MW*", "annualized run-rate", "Energy Consumption (kWh) 1,673,681 681,364", "existing data centers run 90 MW*", "an agreement to buy turbines", "broke ground on 40 MW", "batteries of every kind were deployed",
)
_ROWS = ("", "before it. {}. An additional 120 MW is planned. End", "Total {} by 2031? No. purchases of property", "pre-construction {} and more")
_NOTES = ("", "* Under development as of March", "* Site area in square feet")


def _pick(values: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][cast({i} % {len(values)} + 1 AS integer)]"


_FLAGS = ", ".join(f"regexp_matches(q, '(?i){getattr(p, k)}') AS {n}" for k, n in (("STORAGE", "sto"), ("SOLD", "sold"), ("CONSUME", "con"), ("GENERATE", "gen"), ("CAPEX", "cap"), ("FINANCING", "fin"), ("DEAL", "deal"), ("FORWARD", "fwd"), ("RUN_RATE", "rr"), ("FUTURE_CAPACITY", "fut"), ("OPERATING", "ope"), ("TOTAL", "tot")))


@Q.add("figure_semantics", with_sql("figures") + rf""", f AS (SELECT figure_id, {_pick(_METRICS, 'source_id')} AS m, {_pick(_QUOTES, 'figure_id')} AS q, {_pick(_ROWS, '(figure_id // 13)')} AS ro, {_pick(_NOTES, '(figure_id // 7)')} AS note,
  try_cast(nullif(regexp_extract(period, '(20[0-9]{{2}}|19[0-9]{{2}})', 1), '') AS integer) AS y, is_primary AS pr FROM figures),
g AS (SELECT *, replace(ro, '{{}}', q) AS r, CASE WHEN ro = '' THEN '' WHEN starts_with(ro, 'before') THEN q || '.' WHEN starts_with(ro, 'Total') THEN 'Total ' || q || ' by 2031?' ELSE 'pre-construction ' || q || ' and more' END AS sent,
  {_FLAGS}, coalesce(y > 2000, false) AS late FROM f),
h AS (SELECT *, CASE WHEN m = 'energy_supplied' AND gen AND NOT sold THEN 'energy_generated' ELSE m END AS k, m IN ('energy_consumption', 'electricity_consumption') AS co, contains(q, '*') AS starred,
  regexp_matches(q || ' ' || r, '(?i){p.CAPEX}') AS anycap, regexp_matches(sent, '(?i){p.FUTURE_CAPACITY}') AS sfut, contains(note, 'Under development') AND contains(q, '*') AS nfut, note = '' OR NOT contains(q, '*') AS nonote, starts_with(q, 'Energy Consumption (kWh)') AS runs FROM g),
v AS (SELECT *, CASE WHEN m IN {fg.ENERGY_KEYS} AND sto THEN 'energy_storage_deployed|moved' WHEN m = 'energy_supplied' AND k = m THEN 'energy_sold|moved' WHEN co AND sold AND NOT con THEN 'energy_sold|moved' WHEN co AND gen AND NOT con THEN 'energy_generated|moved'
  WHEN k = 'energy_generated' AND sold AND NOT gen THEN 'energy_sold|moved' WHEN k IN {fg.SCORED_ENERGY} AND late THEN k || '|future period' WHEN k IN {fg.SCORED_ENERGY} AND NOT tot AND runs THEN k || '|ambiguous'
  WHEN m = 'datacenter_capacity_operating' AND (fut OR late OR (NOT ope AND sfut) OR nfut OR (NOT ope AND starred AND nonote)) THEN 'datacenter_capacity_planned|moved'
  WHEN m = 'capex' AND fin THEN m || '|financing' WHEN m = 'capex' AND deal AND NOT cap THEN m || '|deal' WHEN m = 'capex' AND NOT anycap THEN m || '|not a capital expenditure' WHEN m = 'capex' AND fwd THEN m || '|forecast' WHEN m = 'capex' AND NOT pr THEN m || '|not a primary source'
  WHEN m = 'revenue' AND rr THEN m || '|run rate' WHEN m = 'revenue' AND fwd THEN m || '|forecast' WHEN m IN ('capex', 'revenue') AND y IS NULL THEN m || '|no period' WHEN m IN ('capex', 'revenue') AND late THEN m || '|future period' ELSE k || '|' END AS v FROM h)
SELECT figure_id, split_part(v, '|', 1) AS metric_key, split_part(v, '|', 2) AS reason FROM v""")
def figure_semantics(spark, sf_dir):
    f = derived(spark, sf_dir, "figures")
    choose = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    f = f.withColumns({"m": choose(_METRICS, F.col("source_id")), "q": choose(_QUOTES, F.col("figure_id")), "ro": choose(_ROWS, F.floor(F.col("figure_id") / 13)), "note": choose(_NOTES, F.floor(F.col("figure_id") / 7))})
    f = f.withColumn("row", F.replace("ro", F.lit("{}"), F.col("q")))
    year = F.nullif(F.regexp_extract("period", "(20[0-9]{2}|19[0-9]{2})", 1), F.lit("")).cast("int")
    notes = fg.footnote_texts(F.col("q"), F.concat_ws(" ", "row", "note"))
    v = f.select("figure_id", fg.check_figure(F.col("m"), F.col("q"), year, F.col("is_primary"), 2000, F.col("row"), notes).alias("v"))
    return v.select("figure_id", "v.metric_key", "v.reason")


_LETTERS = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@Q.add("letter_places", r"""WITH c AS (SELECT doc_id, list_filter(list_transform(range(1, length(text) + 1), lambda i: {'i': i, 'c': substr(text, i, 1)}), lambda x: regexp_matches(x.c, '[\p{L}\p{N}]')) AS k FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, len(k) AS n, md5(array_to_string(list_transform(k, lambda x: lower(x.c)), '')) AS letters, md5(array_to_string(list_transform(k, lambda x: x.i), ',')) AS places FROM c""")
def letter_places(spark, sf_dir):
    """The index of every whole text: how many letters and digits, which, and where each stands."""
    ship_for_texts(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", qt.letter_index(F.coalesce("text", F.lit(""))).alias("x"))
    return d.select("doc_id", F.size("x.places").cast("long").alias("n"), F.md5("x.letters").alias("letters"), F.md5(F.array_join(F.col("x.places").cast("array<string>"), ",")).alias("places"))


@Q.add("quote_spans", rf"""WITH q AS (SELECT item_id, text AS quote, {_LETTERS.format("text")} AS sk, trim(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' "''') AS norm FROM benchmark),
d AS (SELECT doc_id, text, {_LETTERS.format("text")} AS tsk, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS tnorm FROM documents WHERE doc_id IS NOT NULL),
hit AS (SELECT *, strpos(tsk, sk) AS k FROM q JOIN d ON contains(tsk, sk) WHERE length(norm) BETWEEN 20 AND 600 AND length(sk) >= 14),
pos AS (SELECT doc_id, list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 1), '[\p{{L}}\p{{N}}]')) AS p FROM (SELECT DISTINCT doc_id, text FROM hit)),
core AS (SELECT hit.*, p[k] AS a, p[k + length(sk) - 1] AS b FROM hit JOIN pos USING (doc_id)),
wide AS (SELECT *, a - least(length(regexp_extract(trim(quote), '^[^\p{{L}}\p{{N}}\s]*')), length(regexp_extract(substr(text, 1, a - 1), '[^\p{{L}}\p{{N}}\s]*$'))) AS s,
  b + least(length(regexp_extract(trim(quote), '[^\p{{L}}\p{{N}}\s]*$')), length(regexp_extract(substr(text, b + 1), '^[^\p{{L}}\p{{N}}\s]*'))) AS e FROM core)
SELECT item_id, doc_id, CASE WHEN contains(tnorm, norm) THEN 'exact' ELSE 'loose' END AS method, s AS start, e AS "end", substr(text, s, e - s + 1) AS span FROM wide""")
def quote_spans(spark, sf_dir):
    """Where whole benchmark texts stand in whole documents, every pair of them."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    at = qt.quote_places(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    return at.select(F.col("quote_id").alias("item_id"), F.col("source_id").alias("doc_id"), "method", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "span")


@Q.add("figure_chain")
def figure_chain(spark, sf_dir):
    """Figures quoted from made-up sources, through the whole chain of checks."""
    f = m.with_si(derived(spark, sf_dir, "figures"))
    amount = F.format_number(F.floor("value"), 0)
    quote = F.concat(F.lit("In the year the company reported "), amount, F.lit(" "), F.col("unit"), F.when(F.col("figure_id") % 3 == 0, " of capital expenditures").otherwise(" in total use of energy"))
    rows = f.select("figure_id", F.xxhash64("figure_id", "value", "unit").alias("source_id"), "metric_key", F.floor("value").cast("double").alias("value"), F.coalesce("canonical", "unit").alias("unit"), (F.col("si") / F.col("value")).alias("factor"), F.col("year").alias("period_year"), "is_primary", quote.alias("quote"))
    found = F.when(F.col("figure_id") % 11 == 0, "Nothing of the kind is said here.").otherwise(F.concat(F.lit("Introduction (in thousands). "), F.col("quote"), F.lit(". More follows.")))
    return qt.verify_figures(rows, rows.groupBy("source_id").agg(F.max(found).alias("text")), 2000)


@Q.add("table_scales", rf"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '(in millions) (In Thousands) ' WHEN 1 THEN 'amounts in millions: ' ELSE '' END || text AS t FROM documents WHERE text IS NOT NULL), a AS (SELECT *, length(t) // 2 + 1 AS k FROM d),
w AS (SELECT doc_id, lower(regexp_extract_all(substr(t, greatest(k - 8000, 1), k + 200 - greatest(k - 8000, 1)), '(?i){p.TABLE_SCALE}', 1)[-1]) AS word FROM a)
SELECT doc_id, CASE word WHEN 'thousands' THEN 1000 WHEN 'millions' THEN 1000000 WHEN 'billions' THEN 1000000000 ELSE -1 END AS factor FROM w""")
def table_scales(spark, sf_dir):
    """The scale that holds in the middle of whole documents, stated at their start if it is near enough."""
    i = F.col("doc_id") % 3
    t = F.concat(F.when(i == 0, "(in millions) (In Thousands) ").when(i == 1, "amounts in millions: ").otherwise(""), F.col("text"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t"))
    middle = F.floor(F.length("t") / 2).cast("int") + 1
    return d.select("doc_id", F.coalesce(fg.table_scale(F.col("t"), middle).cast("long"), F.lit(-1)).alias("factor"))


_CLAIMS = ("It operates 3 GW today.", "A further 3 GW is planned by 2027, operating later.", "The 3,000 MW plant is running.", "Others are operating 30 GW now.")


@Q.add("future_sentences", rf"""WITH d AS (SELECT doc_id, trim(text || '. ' || [{', '.join(f"'{c}'" for c in _CLAIMS)}][cast(doc_id % 4 + 1 AS integer)] || ' ' || text, E' \t\n\r\x0B\f') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(string_split(r, chr(1))) AS s, generate_subscripts(string_split(r, chr(1)), 1) AS i FROM (SELECT doc_id, regexp_replace(t, '([.!?])[ \t\n\r\x0B\f]+', '\1' || chr(1), 'g') AS r FROM d)),
k AS (SELECT *, regexp_matches(s, '(?i){p.OPERATING}') AND (regexp_matches(s, '(?i)(^|[^0-9.])3\s*(GW|gigawatts?)\b') AND NOT regexp_matches(s, '(?is)({p.PLANNED_NEAR}.{{0,20}}(^|[^0-9.])3\s*(GW|gigawatts?)\b|(^|[^0-9.])3\s*(GW|gigawatts?)\b.{{0,25}}{p.PLANNED_NEAR})')
  OR regexp_matches(s, '(?i)(^|[^0-9.])3,?000\s*(MW|megawatts?)\b')) AS gone FROM s)
SELECT doc_id, coalesce(md5(nullif(trim(string_agg(s, ' ' ORDER BY i) FILTER (NOT gone)), '')), '') AS kept, count(*) FILTER (gone) AS n FROM k GROUP BY doc_id""")
def future_sentences(spark, sf_dir):
    """Whole documents around a sentence on 3 GW, which goes where it calls planned capacity running."""
    said = F.element_at(F.array(*[F.lit(c) for c in _CLAIMS]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.col("text"), F.lit(". "), said, F.lit(" "), F.col("text")).alias("t"))
    kept = fg.without_future(F.col("t"), F.array(F.lit(3000.0)))
    count = lambda t: F.regexp_count(F.trim(t), F.lit(r"[.!?]\s")) + 1
    d = d.select("doc_id", "t", kept.alias("k"))
    return d.select("doc_id", F.coalesce(F.md5("k"), F.lit("")).alias("kept"), (count(F.col("t")) - F.coalesce(count(F.col("k")), F.lit(0))).cast("long").alias("n"))


@Q.add("unit_words", r"""WITH d AS (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'used 5 Gigawatt-hours. ' WHEN 1 THEN 'used 5 agwhx. ' WHEN 2 THEN 'in $ and 7GWh ' ELSE '' END || text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_matches(t, '(^|[^a-z])(gwh|gigawatt hour|gigawatt-hour|gigawatthour)') AS gwh, regexp_matches(t, '(^|[^a-z])(\$|usd|dollar)') AS usd, regexp_matches(t, '(^|[^a-z])w') AS other FROM d""")
def unit_words(spark, sf_dir):
    """Units sought in whole documents, one of them as it was written."""
    i = F.col("doc_id") % 4
    around = F.concat(F.when(i == 0, "used 5 Gigawatt-hours. ").when(i == 1, "used 5 agwhx. ").when(i == 2, "in $ and 7GWh ").otherwise(""), F.col("text"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", around.alias("a"))
    return d.select("doc_id", *[qt.unit_present(F.lit(u), F.col("a")).alias(n) for u, n in (("GWh", "gwh"), ("USD", "usd"), ("w", "other"))])


@Q.add("full_normal_text")
def full_normal_text(spark, sf_dir):
    """Normal forms after compatibility composition, which DuckDB has no function for."""
    from factweir.functions import kernels
    from factweir.shipping import ship_for_texts

    ship_for_texts(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normal_text(kernels.nfkc("text"))).alias("normal"))


QUERIES, ORACLE = Q.functions, Q.sql
