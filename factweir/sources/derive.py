"""The engine's input tables, derived deterministically from the driver tables.

Each is plain SQL that Spark and DuckDB read alike, so the SQL oracles start from the same rows.
`derived` gives the DataFrame, `with_sql` the same tables as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factweir.tables import table

#: The moment that time windows end at.
NOW = "TIMESTAMP '2001-07-15 12:00:00'"

DERIVED = {
    "companies": """
        SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS industry, n_name AS country, c_custkey % 2 = 0 AS has_legacy
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "runs": """
        SELECT o_orderkey AS run_id, o_custkey AS company_id, o_orderdate AS finished_at,
          CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 29 = 0 THEN 'queued' WHEN o_orderkey % 31 = 0 THEN 'running'
               ELSE 'succeeded' END AS status,
          CASE WHEN o_orderkey % 39 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'budget' END AS error_type,
          CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 END AS coverage,
          CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 101 AS DOUBLE) / 100 END AS confidence,
          CAST((o_orderkey * 11) % 101 AS DOUBLE) / 100 AS measured_coverage,
          CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS DOUBLE) / 100 END AS index_score,
          o_orderkey % 19 <> 0 AND (o_orderkey * 37) % 101 >= 60 AS ranked,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 37) % 101 >= 60 AND o_orderkey % 7 <> 1 END AS published,
          o_orderkey % 9 = 4 AS degraded,
          CASE WHEN o_orderkey % 17 = 3 THEN 'energy_unreadable' ELSE 'standard' END AS basis,
          o_orderkey % 23 = 5 AS retracted,
          CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE concat('pipeline-v2.', CAST(o_orderkey % 12 AS STRING)) END AS version,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 41 END AS cost_cents,
          o_orderkey % 1000 AS tokens,
          CASE WHEN o_orderkey % 4 = 0 THEN 'energy_retry' WHEN o_orderkey % 4 = 1 THEN 'sweep' ELSE 'manual' END AS run_trigger,
          o_orderkey % 5 AS claims_verified,
          concat(CASE WHEN o_orderkey % 3 = 0 THEN 'low coverage; retry scheduled' ELSE 'low coverage' END) AS reason
        FROM orders""",
    "category_scores": """
        SELECT l_orderkey AS run_id, min(l_linenumber) AS ordinal,
          CASE l_linenumber WHEN 1 THEN 'energy_throughput' WHEN 2 THEN 'compute_capacity' WHEN 3 THEN 'growth'
            WHEN 4 THEN 'frontier_acceleration' WHEN 5 THEN 'builder_velocity' WHEN 6 THEN 'policy_stance' ELSE 'unlisted' END AS category,
          CASE WHEN max(l_suppkey) % 6 = 0 THEN NULL ELSE CAST(CAST(max(l_quantity) AS BIGINT) * 2 AS DOUBLE) / 10 END AS score,
          CAST(max(l_partkey) % 121 - 10 AS DOUBLE) / 100 AS confidence
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "figures": """
        SELECT l_suppkey AS entity_id, l_orderkey * 8 + l_linenumber AS figure_id, l_partkey AS source_id,
          CASE l_linenumber WHEN 1 THEN 'energy_consumption' WHEN 2 THEN 'electricity_consumption' WHEN 3 THEN 'energy_generated'
            WHEN 4 THEN 'datacenter_capacity_operating' WHEN 5 THEN 'datacenter_capacity_planned' WHEN 6 THEN 'capex' ELSE 'revenue' END AS metric_key,
          l_extendedprice AS value,
          CASE WHEN l_linenumber <= 3 THEN CASE l_partkey % 4 WHEN 0 THEN 'MWh' WHEN 1 THEN 'GWh' WHEN 2 THEN 'megawatt hours' ELSE 'TJ' END
               WHEN l_linenumber <= 5 THEN CASE l_partkey % 3 WHEN 0 THEN 'MW' WHEN 1 THEN 'kW' ELSE 'megawatts' END
               ELSE CASE l_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN '$ millions' WHEN 2 THEN 'EUR' ELSE 'thousand dollars' END END AS unit,
          CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('FY', CAST(year(l_shipdate) AS STRING)) END AS period,
          l_returnflag = 'A' AS is_primary, CASE WHEN l_linestatus = 'F' THEN 'edgar' ELSE 'quote' END AS origin
        FROM lineitem""",
    "page_views": """
        SELECT event_id, ts, concat('/', event_type, CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('/', CAST(user_id % 25 AS STRING)) END) AS path,
          CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('https://www.Site', CAST(user_id % 9 AS STRING), '.example/a?b=c') END AS referer,
          CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'x1' ELSE substr('usdefresgbnl', CAST((event_id % 6) * 2 AS INT) - 1, 2) END AS country_header,
          concat('utm_source=', CASE WHEN user_id % 3 = 0 THEN ' News ' WHEN user_id % 3 = 1 THEN '' ELSE 'feed' END, '&k=1') AS query,
          CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'Googlebot/2.1' WHEN event_id % 10 = 2 THEN 'UptimeRobot bot'
               WHEN event_id % 10 = 3 THEN 'curl/8' ELSE 'Mozilla/5.0' END AS user_agent,
          CASE WHEN event_id % 10 = 9 THEN 'application/json' ELSE 'text/html,*/*' END AS accept,
          concat('10.0.', CAST(user_id AS STRING), '.1, 10.9.9.9') AS forwarded_for, CAST(user_id AS STRING) AS user_key,
          CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status
        FROM events""",
    "source_docs": """
        SELECT doc_id AS source_id, doc_id % 40 AS run_id, text,
          concat(CASE WHEN doc_id % 2 = 0 THEN 'https://WWW.' ELSE 'http://' END, source, '.Example.com', CASE WHEN doc_id % 3 = 0 THEN '/' ELSE concat('/a', CAST(doc_id % 10 AS STRING), '/') END, CASE WHEN doc_id % 4 = 0 THEN '#top' ELSE '' END) AS url,
          CASE WHEN doc_id % 7 = 0 THEN 404 WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 503 ELSE 200 END AS http_status,
          CASE WHEN doc_id % 5 = 0 THEN 'edgar' WHEN doc_id % 5 = 1 THEN 'citation' ELSE 'research' END AS origin,
          CASE WHEN doc_id % 17 = 0 THEN 'blocked by policy' END AS error, doc_id % 3 = 0 AS is_primary
        FROM documents""",
    "links": """
        SELECT doc_id AS source_id, doc_id % 40 AS run_id, doc_id AS candidate_id,
          concat('https://', CASE doc_id % 7 WHEN 0 THEN 'www.acme.com' WHEN 1 THEN 'ir.acme.com' WHEN 2 THEN 'www.cdp.net' WHEN 3 THEN 'news.example.org' WHEN 4 THEN 'investors.acme.com' WHEN 5 THEN 'notacme.com' ELSE 'acme.com' END,
            CASE doc_id % 11 WHEN 0 THEN '/sustainability/' WHEN 1 THEN '/investors/' WHEN 2 THEN '/newsroom/energy-use-up' WHEN 3 THEN '/files/impact-report-2023.pdf' WHEN 4 THEN '/en/climate/overview'
              WHEN 5 THEN '/about' WHEN 6 THEN '/docs/gri-index' WHEN 7 THEN '' WHEN 8 THEN '/files/full-esg-databook.pdf' WHEN 9 THEN '/blog' ELSE '/data/energy-data.xlsx' END) AS url,
          CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Energy consumption and scope 2' WHEN 2 THEN 'Annual review' WHEN 3 THEN 'Environmental data appendix' ELSE 'Home' END AS title,
          CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'dead' WHEN 2 THEN 'error' WHEN 3 THEN 'thin' WHEN 4 THEN 'dead' ELSE 'soft_404' END AS status,
          CASE doc_id % 13 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN NULL WHEN 4 THEN 520 WHEN 5 THEN 410 ELSE 200 END AS http_status,
          CASE doc_id % 8 WHEN 0 THEN 'Read timed out' WHEN 1 THEN 'connection reset' WHEN 2 THEN NULL ELSE 'refused' END AS reject_reason,
          CASE doc_id % 4 WHEN 0 THEN 'edgar' WHEN 1 THEN 'citation' ELSE 'research' END AS origin,
          CASE doc_id % 3 WHEN 0 THEN 'energy,growth' WHEN 1 THEN 'policy' ELSE 'energy' END AS covers,
          CASE doc_id % 9 WHEN 0 THEN 'states electricity use of data centers' WHEN 1 THEN 'sustainability report' WHEN 2 THEN NULL ELSE 'mentions chips' END AS why,
          CASE WHEN doc_id % 40 = 7 THEN NULL ELSE 'https://www.acme.com/about' END AS domain,
          CASE doc_id % 10 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'used' ELSE NULL END AS outcome,
          CASE WHEN doc_id % 20 < 10 THEN 'archive.org unavailable (503)' ELSE 'nothing archived' END AS note
        FROM documents""",
    "fact_rows": """
        SELECT o_custkey AS cik, CASE o_orderkey % 5 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'PaymentsToAcquirePropertyPlantAndEquipment' WHEN 2 THEN 'PaymentsToAcquireProductiveAssets' WHEN 3 THEN 'SalesRevenueNet' ELSE 'Assets' END AS concept,
          concat(CAST(year(o_orderdate) - 1 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN '-09-01' ELSE '-01-01' END) AS start_day, concat(CAST(year(o_orderdate) - 1 AS STRING), '-12-31') AS end_day,
          CAST(floor(o_totalprice) AS DOUBLE) AS val, concat('0000000001-24-', CAST(1000000 + o_orderkey AS STRING)) AS accn,
          CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '10-Q' ELSE '20-F' END AS form, CAST(CAST(o_orderdate AS DATE) AS STRING) AS filed
        FROM orders""",
    "answer_items": """
        SELECT l_orderkey AS answer_id, l_linenumber - 1 AS pos, l_orderkey % 50 = 7 AS broken,
          CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'S9' ELSE concat('S', CAST(l_partkey % 4 AS STRING)) END AS source_id,
          CASE l_suppkey % 7 WHEN 0 THEN 'capex' WHEN 1 THEN 'energy_consumed' WHEN 2 THEN 'headcount' WHEN 3 THEN ' revenue ' WHEN 4 THEN '' ELSE 'energy_generated' END AS metric_key,
          CASE l_orderkey % 6 WHEN 0 THEN 'many' WHEN 1 THEN '-12.5' WHEN 2 THEN NULL ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) END AS value,
          CASE l_partkey % 5 WHEN 0 THEN ' ' ELSE 'MWh' END AS unit, CASE l_partkey % 7 WHEN 0 THEN NULL ELSE concat('quote ', CAST(l_partkey AS STRING)) END AS quote,
          CASE l_partkey % 5 WHEN 0 THEN 'frontier_acceleration' WHEN 1 THEN 'builder_velocity' WHEN 2 THEN 'overall' ELSE 'policy_stance' END AS category,
          CASE l_suppkey % 5 WHEN 0 THEN '11' WHEN 1 THEN NULL ELSE CAST(l_suppkey % 10 AS STRING) END AS score,
          concat('[E', CAST(l_partkey % 6 AS STRING), ']') AS ref
        FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) AS li""",
    "evidence": """
        SELECT doc_id AS evidence_id, doc_id % 40 AS run_id, concat(text, CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE ' ' END, 'end') AS quote, concat('d', CAST(doc_id % 3 AS STRING)) AS domain,
          doc_id % 4 <> 0 AS verified, CASE doc_id % 5 WHEN 0 THEN 'unit not near' WHEN 1 THEN 'forecast' ELSE NULL END AS reason, doc_id % 10 AS claim_start
        FROM documents""",
    "judged": """
        SELECT l_suppkey AS entity_id, CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'd' END AS category, CAST(floor(l_quantity) AS DOUBLE) / 5 AS score,
          CASE WHEN l_partkey % 9 = 0 THEN 'stub' ELSE 'judge' END AS model, l_shipdate AS judged_at, l_orderkey * 8 + l_linenumber AS score_id
        FROM lineitem WHERE l_suppkey % 3 = 0 OR l_linenumber < 3""",
    "waiting": """
        SELECT o_orderkey AS run_id, o_orderdate AS queued_at, CASE WHEN o_orderkey % 3 = 0 THEN 'queued' ELSE 'succeeded' END AS status,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END AS next_attempt, o_orderkey % 6 AS attempt
        FROM orders""",
    "hops": """
        SELECT url, CASE page_id % 6 WHEN 0 THEN 'https://hub.example.com/all' WHEN 1 THEN concat('/moved/', CAST(page_id % 5 AS STRING)) WHEN 2 THEN concat('//other.example.org/', CAST(page_id % 4 AS STRING)) WHEN 3 THEN 'http://10.0.0.7/inner' ELSE NULL END AS location FROM pages
        UNION ALL SELECT concat('https://hub.example.com/', CAST(page_id AS STRING)), concat('/', CAST(page_id + 1 AS STRING)) FROM pages WHERE page_id < 9
        UNION ALL SELECT concat(scheme, '://other.example.org/', CAST(page_id AS STRING)), CASE page_id WHEN 0 THEN 'https://hub.example.com/6' WHEN 1 THEN 'https://hub.example.com/0' WHEN 2 THEN '/3' ELSE '/2' END FROM pages CROSS JOIN (SELECT 'http' AS scheme UNION ALL SELECT 'https') AS s WHERE page_id < 4
        UNION ALL SELECT 'https://hub.example.com/all', 'https://hub.example.com/8' FROM pages WHERE page_id < 2""",
    "addresses": """
        SELECT o_orderkey AS id, o_orderkey % 2 AS six,
          (o_orderkey * 7919) % 256 AS a, (o_orderkey * 104729) % 256 AS b, (o_orderkey * 1299709) % 256 AS c, o_orderkey % 256 AS d,
          CASE o_orderkey % 9 WHEN 0 THEN '2001:db8' WHEN 1 THEN 'fe80:0' WHEN 2 THEN 'fd00:1' WHEN 3 THEN '2001:1' WHEN 4 THEN '64:ff9b' WHEN 5 THEN '2606:4700' WHEN 6 THEN '0:0' WHEN 7 THEN '2001:20' ELSE 'ff02:0' END AS head
        FROM orders""",
    "capture_answers": """
        SELECT doc_id, concat('https://site.example/', CAST(doc_id AS STRING)) AS url, CASE WHEN doc_id % 13 = 5 THEN 503 ELSE 200 END AS status,
          CASE doc_id % 8 WHEN 0 THEN '[]' WHEN 1 THEN 'down' WHEN 2 THEN '[["original","timestamp"],["u","20190102030405"],["u","bad"],["u","20210102030405"]]'
            ELSE concat('[["timestamp","original"],["2018010203040', CAST(doc_id % 7 AS STRING), '","u"],["20190102030405","u"],["20200102030405","u"],["20210102030405","u"],["",null]]') END AS body
        FROM documents WHERE doc_id IS NOT NULL""",
    "capture_copies": """
        SELECT concat('https://site.example/', CAST(doc_id AS STRING)) AS url, stamp, CASE WHEN doc_id % 11 = 3 AND stamp = '20200102030405' THEN 429 WHEN doc_id % 17 = 2 THEN 503 ELSE 200 END AS http,
          CASE WHEN (doc_id + length(text)) % 3 = 0 THEN 'ok' ELSE 'thin' END AS status, CASE WHEN doc_id % 5 = 0 AND stamp = '20210102030405' THEN 'Access Denied' ELSE 'Report' END AS title, text
        FROM documents CROSS JOIN (SELECT '20190102030405' AS stamp UNION ALL SELECT '20200102030405' UNION ALL SELECT '20210102030405') AS s WHERE doc_id IS NOT NULL""",
    "link_pages": """
        SELECT page_id, url, concat(html, '<p><a class="k" href="/files/impact-report-', CAST(2018 + page_id % 6 AS STRING), '.pdf#p2">Impact  report <b>', CASE WHEN page_id % 3 = 0 THEN 'highlights' ELSE 'extended' END, '</b></a>',
          '<A HREF=''https://cdn.example.org/esg-data-', CAST(2019 + page_id % 5 AS STRING), '.PDF?v=1&amp;x=2''>Data appendix</A><a href="#top">ESG energy</a><a href="mailto:a@b.c">energy</a><a href="/files/menu.pdf">Lunch</a>',
          '<a href="/files/climate.pdf">Climate ', CASE WHEN page_id % 4 = 0 THEN 'overview 2022' ELSE 'figures' END, '</a><a href="/files/climate.pdf">again, energy</a><a href="/energy.html">Energy 2023</a>') AS html
        FROM pages WHERE url NOT LIKE '%[%'""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = DERIVED[name]
    used = {m for m in re.findall(r"(?:FROM|JOIN) (\w+)", sql)}
    text = re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_sql(*names: str) -> str:
    """WITH clause of the derived tables, for the oracles."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names)
