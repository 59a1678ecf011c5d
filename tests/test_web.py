"""Redirects, stand-in pages, captures, links and embedded data against plain versions."""

import json
import random
import re

import pytest
from factweir.functions import kernels
from factweir.functions import patterns as p
from factweir.operators import web
from factweir.plans import registry
from pyspark.sql import functions as F


def test_redirects_with_a_hub_loops_and_long_chains(spark):
    hops = [(f"http://a.example/{i}", "//hub.example/x") for i in range(400)] + [("http://hub.example/x", "/y"), ("http://hub.example/x", "/z"), ("http://l.example/1", "2"), ("http://l.example/2", "1"), ("http://s.example/", "http://s.example/"), ("http://p.example/", "http://127.0.0.1/"), (None, "x"), ("http://n.example/", None), ("http://e.example/", "")]
    hops += [(f"http://c.example/{k}", f"{k + 1}") for k in range(9)]
    urls = [(i, f"http://a.example/{i}") for i in range(400)] + [(1000, "http://l.example/1"), (1001, "http://s.example/"), (1002, "http://p.example/"), (1003, None), (1004, "http://n.example/"), (1005, "http://e.example/"), (1006, "http://10.0.0.1/")]
    urls += [(2000 + k, f"http://c.example/{k}") for k in range(9)] + [(7, "http://hub.example/x")]
    got = {(r.id, r.url): r for r in web.follow_redirects(spark.createDataFrame(urls, "id long, url string"), spark.createDataFrame(hops, "url string, location string")).collect()}
    assert len(got) == len(urls)
    for i in range(400):
        r = got[i, f"http://a.example/{i}"]
        assert (r.final_url, r.path, r.error) == ("http://hub.example/y", [f"http://a.example/{i}", "http://hub.example/x"], None)
    by = {k: (r.final_url, len(r.path), r.error) for (k, _), r in got.items() if k >= 1000}
    assert by[1000] == (None, 2, "redirect loop") and by[1001] == (None, 1, "redirect loop") and by[1002] == (None, 1, "not allowed") and by[1006] == (None, 0, "not allowed")
    assert by[1003] == (None, 0, "not allowed") and by[1004] == ("http://n.example/", 0, None) and by[1005] == ("http://e.example/", 0, None)
    for k in range(9):
        left = 9 - k
        assert by[2000 + k] == ((f"http://c.example/{9}", left, None) if left <= 5 else (None, 6, "too many redirects"))


def plain_strings(value):
    if isinstance(value, str):
        return [value]
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in children for s in plain_strings(v)]


def test_strings_of_json_depth_first(spark):
    rng = random.Random(2)
    words = ["z", "a b", 'quo"te', "back\\slash", "\\", '\\"', "né\n", " ", "", "{x}", "a:b", "😀", ":"]

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice([*words, 1, 2.5, None, True])
        if kind < 0.7:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(words) + str(i): made(depth - 1) for i in range(rng.randint(0, 3))}

    values = [made(5) for _ in range(200)]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1) for i, v in enumerate(values)]
    broken = [None, "", "{", '{"a": "b}', "[1,]x", '["a" "b"]', "nul"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + broken)], "i int, t string").select("i", web.json_strings(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.s == (plain_strings(values[r.i]) if r.i < len(values) else None), r.i


def plain_prose(html):
    out, total = [], 0
    for m in re.finditer(r"(?is)<script\b([^>]*)>(.*?)</script\s*>", html):
        get = lambda name: (re.search(rf"""(?i){name}\s*=\s*["']?([^"'\s>]*)""", m[1]) or ["", ""])[1]  # noqa: B023, E731
        own = get("id") == "__NEXT_DATA__"
        if not own and (get("type").lower() not in ("application/json", "application/ld+json") or re.search(p.SITE_WIDE_ISLAND, get("id"), re.IGNORECASE)):
            continue
        try:
            data = json.loads(m[2])
        except ValueError:
            continue
        held = 0
        for s in plain_strings((data.get("props") or {}).get("pageProps", data) if own and isinstance(data, dict) else data):
            s = s.strip()
            if len(s) < 25 or " " not in s or re.search(p.NO_PROSE, s, re.IGNORECASE) or s[0] in "{[<":
                continue
            s = re.sub(r"\s+", " ", s)
            if held < web.ISLAND_CHARS and total <= web.PAGE_CHARS and s not in out:
                out.append(s)
                held += len(s)
                total += len(s)
    return out


def test_prose_of_islands(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["A sentence that is long enough to count", "https://x.example/a b c d e f g h i j k", "<b>markup is no prose at all here</b>", "  Another one,\nwith   blanks in it  ", "short one", "Noblanksinthisoneatallwhichislong", "see /img/a.png?x and more words here", "Third text with enough words in it to be kept"]
    pages = []
    for i in range(60):
        islands = ""
        for _ in range(rng.randint(0, 4)):
            body = {"b": [rng.choice(texts) + str(rng.randrange(4)) for _ in range(rng.randint(0, 6))], "a": {"x": rng.choice(texts)}}
            name = rng.choice(['id="__NEXT_DATA__"', 'type="application/json"', "type='application/ld+json; charset=utf-8'".replace("; charset=utf-8", ""), 'type="application/json" id="site-config"', 'type="text/javascript"', ""])
            whole = {"props": {"pageProps": body}, "z": "A text of the application and not the page"} if "NEXT" in name and rng.random() < 0.8 else body
            islands += f"<script {name}>{json.dumps(whole) if rng.random() < 0.9 else '{broken'}</script>"
        pages.append((i, f"<p>x</p>{islands}"))
    pages += [(900, None), (901, ""), (902, "<script type='application/json'>")]
    for most in (10**6, 90):
        monkeypatch.setattr(web, "ISLAND_CHARS", most)
        monkeypatch.setattr(web, "PAGE_CHARS", 2 * most)
        got = {r.i: r.p for r in spark.createDataFrame(pages, "i int, h string").select("i", web.embedded_prose(F.col("h")).alias("p")).collect()}
        for i, h in pages:
            assert (got[i] or []) == plain_prose(h or ""), h
    shown = lambda v, *prose: spark.range(1).select(web.with_prose(F.lit(v), F.array(*map(F.lit, prose)).cast("array<string>")).alias("t")).first().t
    assert shown("Shell", "More here", "Shell") == "Shell More here" and shown("x" * 2000, "More") == "x" * 2000 and shown("", "Only this") == "Only this" and shown("Shell") == "Shell"


def test_captures_from_index_to_choice(spark):
    answers = [
        ("a", 200, '[["timestamp","original"],["1","u"],["2","u"],["3","u"],["4","u"]]'), ("b", 200, '[["original","timestamp"],["u","20"],["u","x"],["u",null],["u","21"]]'), ("c", 200, "[]"), ("d", 200, "oops"),
        ("e", 503, '[["timestamp"],["1"]]'), ("f", 200, None), ("g", 200, '[["timestamp"],[],["7"]]'), ("h", 200, '{"a": 1}'),
    ]
    listed = web.capture_list(spark.createDataFrame(answers, "url string, status int, body string"))
    assert sorted(map(tuple, listed.collect())) == [("a", 1, "4"), ("a", 2, "3"), ("a", 3, "2"), ("b", 1, "21"), ("b", 2, "20"), ("g", 1, "7")]
    nearest = [("a", 200, '{"archived_snapshots": {"closest": {"available": true, "status": "200", "timestamp": "2020"}}}'), ("b", 200, '{"archived_snapshots": {}}'), ("c", 200, '{"archived_snapshots": {"closest": {"available": true, "status": "404", "timestamp": "1"}}}'), ("d", 200, "x")]
    assert list(map(tuple, web.nearest_capture(spark.createDataFrame(nearest, "url string, status int, body string")).collect())) == [("a", 1, "2020")]
    long = "captcha " + "x" * 6000
    copies = [("a", "4", 200, "thin", "t", "x"), ("a", "3", 200, "ok", "Access Denied", "y"), ("a", "2", 200, "ok", "t", long), ("b", "21", 429, "ok", "t", "z"), ("b", "20", 200, "ok", "t", "z")]
    got = {r.url: (r.outcome, r.used, [tuple(t) for t in r.tried]) for r in web.first_capture(listed, spark.createDataFrame(copies, "url string, stamp string, http int, status string, title string, text string")).collect()}
    assert got == {"a": ("used", "2", [("4", "thin"), ("3", "block page"), ("2", "ok")]), "b": ("rate_limited", None, [("21", "rate_limited")]), "g": ("unavailable", None, [("7", "unavailable")])}


def test_ratio_bound_loses_no_pair():
    rng = random.Random(3)
    kept = 0
    for _ in range(1500):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 60)))
        b = list(a) if rng.random() < 0.7 else rng.choices("abcd ", k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 8)):
            b[rng.randrange(len(b) + 1) :][:1] = [] if not b else b[:0]
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.choice("xyz"))
        b = "".join(b)
        for least in (50.0, 80.0, 90.0):
            full = kernels.indel(a, b)
            assert kernels.ratio_at_least(a, b, least) == (full if full >= least and (a and b or a == b) else 0.0)
            kept += full >= least
    assert kept > 500


def test_probe_query_against_all_pairs(spark, data):
    docs = [(r.doc_id, r.source or "", r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    probe = {}
    for i, s, t in sorted(docs):
        if t:
            probe.setdefault(s, t[:3000])
    want = {i: round(kernels.indel(t[:3000], probe[s]), 6) for i, s, t in docs if s in probe and t and kernels.indel(t[:3000], probe[s]) >= 90}
    assert {r.doc_id: r.ratio for r in registry.queries()["probe_pages"](spark, data).collect()} == want and len(want) > 5


def plain_pick(links):
    taken = []
    for year, summary, place in links:
        if len(taken) == 2:
            break
        full = [y for y, s, _ in taken if not s]
        if not (summary and year in full) and not any(y and year and year < y for y in full):
            taken.append((year, summary, place))
    return [n for _, _, n in taken]


def test_picks_against_a_plain_walk(spark, data):
    rng = random.Random(5)
    pages = {k: [(rng.choice([None, 2020, 2021, 2022]), rng.random() < 0.5, n + 1) for n in range(rng.randint(1, 7))] for k in range(150)}
    rows = spark.createDataFrame([(k, n, f"l{n}", y, s) for k, links in pages.items() for y, s, n in links], "page_id int, place int, link string, year int, summary boolean")
    got = {}
    for r in web.pick_links(rows).collect():
        got.setdefault(r.page_id, []).append(r.place)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_pick(v) for k, v in pages.items()}
    listed = {}
    for r in sorted(registry.queries()["report_links"](spark, data).collect(), key=lambda r: r.place):
        listed.setdefault(r.page_id, []).append((r.year, r.summary, r.place))
    chosen = {}
    for r in registry.queries()["picked_links"](spark, data).collect():
        chosen.setdefault(r.page_id, []).append(r.place)
    assert {k: sorted(v) for k, v in chosen.items()} == {k: plain_pick(v) for k, v in listed.items()}


def test_registry_entries(spark, data):
    got = {r.id: r for r in registry.queries()["registry_entries"](spark, data).collect()}
    assert len(got) == spark.read.parquet(f"{data}/supplier.parquet").count()
    assert all(r.path == f"/Company/s-{i}" and r.listed.endswith("Holdings Inc.") for i, r in got.items())
    page = '<a href="/Company/a">Unrelated words</a><a href="/Company/b" x> Solar  Grid Nord plc </a><a href="/Company/c">Solar Grid</a>'
    rows = [(1, "Solar Grid Inc.", page), (2, "Nothing like it", page), (3, "", page), (4, None, page), (5, "Solar Grid", None)]
    got = [tuple(r) for r in web.registry_company(spark.createDataFrame(rows, "id int, name string, html string")).collect()]
    assert got == [(1, "/Company/b", "Solar  Grid Nord plc")]  # all words of the shorter name count as alike, the first of equals wins


@pytest.mark.parametrize(("text", "want"), [
    ("1,053,479 815,864", [1053479, 815864]), ("1 053 479", [1053479, 1, 53, 479]), ("1.053.479", [1053479, 1.053, 479]), ("1.053.479,5 kWh", [1053479.5, 1.053]),
    ("1.234", [1.234]), ("1,234.5", [1234.5, 5]), ("4.2 billion", [4.2, 4.2e9]), ("3 mn and 5 bnx", [3, 3e6, 5]), ("12,34", []), ("in 2023, 5%", [2023, 5]), ("", []), ("１２ ﬁ", [12]), ("1 053 479", [1053479, 1, 53, 479]), ("1,053 million", [1053, 1.053e9]),
])
def test_readings_of_numbers(text, want):
    assert sorted(kernels.numbers(text)) == sorted(want)
