"""DuckDB SQL for the queries that SQL can express, written independently of the DataFrame code."""

from __future__ import annotations

from factweir.llm import license_scan as ls
from factweir.llm import quality_rules as qr

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_filter(patterns: list[tuple[str, str, str, list[str]]]) -> str:
    """patterns: (name, verdict, regular expression over host and path, tokens)."""
    rows = ", ".join(f"({_quote(name)}, {_quote(verdict)}, {_quote(pattern)})" for name, verdict, pattern, _ in patterns)
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS row_id, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_UPPER}) AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT row_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_id),
m(name, verdict, pattern) AS (VALUES {rows}),
own AS (SELECT row_id, max(name) AS name, arg_max(m.verdict, name) AS verdict FROM p, m WHERE regexp_matches(replace(host, chr(10), ' ') || chr(10) || path, pattern) GROUP BY row_id)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best.rule IS NULL THEN own.name END AS method_rule,
       coalesce(best.verdict, own.verdict, 'allow') AS verdict
FROM p LEFT JOIN best USING (row_id) LEFT JOIN own USING (row_id)
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.v, c.v) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def _canonical(c: str) -> str:
    c = f"translate(regexp_replace({c}, '(?im)^[^A-Za-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g'), {_UPPER})"
    for a, b in ls.SPELLINGS:
        c = f"replace({c}, {_quote(a)}, {_quote(b)})"
    return f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"


def license_scan() -> str:
    rows = ", ".join(f"({_quote(a)}, {_quote(b)}, {_quote(t)})" for a, b, t in ls.KNOWN)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
known AS (
  SELECT c, min(license) AS license, arg_min(policy, license) AS policy
  FROM (SELECT license, policy, {_canonical("t")} AS c FROM (VALUES {rows}) v(license, policy, t)) WHERE c <> '' GROUP BY c),
u AS (
  SELECT r, doc_id, true AS whole, {_canonical("t")} AS c FROM d
  UNION ALL
  SELECT r, doc_id, false, {_canonical("line")} FROM (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line FROM d))
SELECT doc_id, min(license) FILTER (whole) AS whole_license,
       coalesce(list_sort(list(DISTINCT license) FILTER (license IS NOT NULL)), []) AS licenses,
       coalesce(list_sort(list(DISTINCT policy) FILTER (policy IS NOT NULL)), []) AS policies,
       count(*) FILTER (NOT whole AND license IS NOT NULL) AS n_lines
FROM u LEFT JOIN known USING (c) GROUP BY r, doc_id
"""


def quality_rules() -> str:
    furniture = "|".join(qr.BOILERPLATE).replace("'", "''")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, i, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT r, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
        len(list_filter(regexp_extract_all(line, '[^ \t\n\r\f\x0B]+'), lambda x: x IN ('|', '>', '•', '·'))) AS bars,
        len(list_filter(regexp_extract_all(line, '[^ \t\n\r\f\x0B]+'), lambda x: regexp_matches(x, '([#*$%&]{{2,}}|!{{2,}})[.,]?$'))) AS marked FROM l),
j AS (SELECT r, i, line, bars >= 3 OR (bars >= 1 AND 3 * bars >= nw) OR (regexp_matches(lower(line), '{furniture}') AND 4 * (len(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+')) - len(regexp_extract_all(regexp_replace(lower(line), '{furniture}', ' ', 'g'), '[\p{{L}}\p{{N}}]+'))) >= len(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+')))
        OR (marked >= 1 AND 2 * marked >= nw) AS bad FROM m),
s AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS lost_lines,
        coalesce(sum(length(line)) FILTER (bad), 0) AS lost_chars, sum(length(line)) AS all_chars,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS clean FROM j GROUP BY r),
f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_lines, 0) AS lost_lines,
        cast(coalesce(lost_chars, 0) AS bigint) AS lost_chars, cast(coalesce(all_chars, 0) AS bigint) AS all_chars, sha256(coalesce(clean, '')) AS clean_sha256
      FROM w LEFT JOIN covered USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_lines, lost_chars, clean_sha256,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * lost_chars > 50 * all_chars) AS kept
FROM f
"""


#: Levels of the trees in SQL: enough for 8 ** 7 rows of a language and as many languages.
_LEVELS = 7


def _tree(t: str, leaves: str) -> str:
    """CTEs {t}0 to {t}7: nodes (g, i, n, d) of each level, where finished trees stay as they are."""
    out = [f"{t}0 AS ({leaves})"]
    for k in range(_LEVELS):
        out.append(f"""{t}{k + 1} AS (
  SELECT g, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {t}{k} WHERE n > 1 GROUP BY g, i // 8, n
  UNION ALL SELECT g, i, n, d FROM {t}{k} WHERE n = 1)""")
    return ",\n".join(out)


def _climb(t: str, w: str, start: str) -> str:
    """CTEs {w}0 to {w}7: each row r with its place i in tree {t}, the folded digest f and the proof p so far."""
    out = [f"{w}0 AS ({start})"]
    for k in range(_LEVELS):
        out.append(f"""{w}{k + 1} AS (
  SELECT a.r, a.g, CASE WHEN any_value(b.n) > 1 THEN a.i // 8 ELSE a.i END AS i,
         CASE WHEN any_value(b.n) > 1 THEN sha256(string_agg(CASE WHEN b.i = a.i THEN a.f ELSE b.d END, '' ORDER BY b.i)) ELSE a.f END AS f,
         a.p || coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i <> a.i), '') AS p
  FROM {w}{k} a JOIN {t}{k} b ON b.g = a.g AND b.i // 8 = a.i // 8 GROUP BY a.r, a.g, a.i, a.f, a.p)""")
    return ",\n".join(out)


def merkle_manifest() -> str:
    field = lambda c: f"coalesce(strlen(cast({c} AS varchar)) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    return f"""
WITH docs AS (SELECT *, coalesce('=' || lang, '') AS g, sha256({head} || {field("text")}) AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(f"translate(text, {_UPPER})")}) ELSE sha256({head} || {field("text")}) END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
{_tree("t", "SELECT g, i, n, leaf AS d FROM placed")},
subroots AS (SELECT g AS r, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d FROM t{_LEVELS}),
{_tree("u", "SELECT g, i, n, d FROM subroots")},
{_climb("t", "w", "SELECT r, g, i, changed AS f, '' AS p FROM placed")},
{_climb("u", "v", f"SELECT w.r, '' AS g, s.i, w.f, w.p FROM w{_LEVELS} w JOIN subroots s ON s.r = w.g")}
SELECT doc_id, leaf, s.d AS subroot, u.d AS root, sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = u.d AS verified
FROM placed a JOIN v{_LEVELS} v USING (r) JOIN subroots s ON s.r = a.g CROSS JOIN u{_LEVELS} u
"""
