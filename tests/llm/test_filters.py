import re

import pytest
from factweir.llm import entries, license_scan, quality_rules, url_filter
from pyspark.sql import functions as F

from tests.llm.brute import HOSTILE, docs
from tests.oracle import connection, same

RULES = entries.URL_RULES
OWN = entries.url_patterns()
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en", "http://example.com/en/x?q#f", "https://a.b.example.com/en/",
    "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://com/", "http://com", "ftp://a://b.net/es/", "http://x.com?u=http://y.net/es/",
    "http://www.spam-farm.org/", "https://big-casino.org", "https://casinos-x.org/a", "https://casinoland.org/", "http://a.org/user/login", "http://a.org/login.php?x", "http://a.org/blogin/", "http://a.org/crack-keygen", "http://a.org/CRACK", "http://antispam.org/", "http://ünï.net/fr/é", "http://" + "a" * 50_000 + ".com/",
    "http://a\nb.example.com/en/x", "http://\nexample.com/en/", "http://x\n.net/fr/\n", "http://net\n/es/", "http://a\nb.casino.org/c\nd", "http://a.org/x\ny/login",
]


def judge(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
        host, path = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(re.search(pattern, "{}\n{}".format(host.replace("\n", " "), path)) for _, _, pattern, _ in OWN) else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, key string")


@pytest.mark.parametrize("inline", [True, False])
def test_urls_match_brute_force(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(url_filter, "MAX_INLINE_RULES", 0)
    rules = url_filter.prefix_rules(spark, RULES).unionByName(url_filter.pattern_rules(spark, OWN))
    got = {r.page_id: r for r in url_filter.judge_urls(pages(spark, URLS + URLS[:3]), rules).collect()}
    for i, u in enumerate(URLS + URLS[:3]):
        host, path, rule, verdict = judge(u)
        own = None if got[i].rule in {r[0] for r in OWN} else got[i].rule
        assert (got[i].host, got[i].path, own, got[i].verdict) == (host, path, rule, verdict), u
    assert url_filter.judge_urls(pages(spark, []), rules).count() == 0


@pytest.mark.parametrize("inline", [True, False])
def test_rules_without_a_token_meet_every_url(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(url_filter, "MAX_INLINE_RULES", 0)
    rules = url_filter.pattern_rules(spark, [("empty", "block", r"^\n$", []), ("dash", "block", "-", []), ("b", "allow", r"\bb\b", ["b"])])
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, [None, "x", "http://a-b/", "http://b/", "http://c/"] + ["http://b/"] * 3), rules).collect()}
    assert got == {0: ("empty", "block"), 1: ("empty", "block"), 2: ("dash", "block"), 3: ("b", "allow"), 4: (None, "allow"), 5: ("b", "allow"), 6: ("b", "allow"), 7: ("b", "allow")}


def test_rarest_token_is_the_key(spark):
    rules = url_filter.prefix_rules(spark, [("block", "example.com", "/rare/"), ("block", "example.com", "/en"), ("block", "-", "/x")])
    keys = spark.createDataFrame([("example.com\n/en/1",), ("example.com\n/en/2",), ("x.com\n/rare/",)], "key string")
    got = {r.rule: r.token for r in url_filter.indexed(rules, keys).collect()}
    assert got == {"example.com/rare/": "rare", "example.com/en": "example", "-/x": None}


@pytest.mark.parametrize("name", ["op2_url_filter", "op7_exact_topk", "op9_license_scan", "op10_quality_rules"])
def test_queries_match_sql(spark, data, name):
    same(entries.queries()[name](spark, data), connection(data), entries.oracle_sql()[name])


def rules_brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered, dup, lines = {}, set(), 0, set()
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_base_matches_brute_force(spark):
    texts = [*HOSTILE, "a b c a b c a b c", "x\nx\n\nx \n" * 30, "a b c d " * 40, "w " * 7, "same line here\n" * 60, " | ".join(f"n{i}" for i in range(80)), "😀 " * 60]
    got = {r.doc_id: r for r in quality_rules.clean_lines(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, *_, repeated = want = rules_brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.clean_lines(docs(spark, [])).count() == 0
    assert quality_rules.clean_lines(docs(spark, [(None, None), (None, None)])).count() == 2


def test_failing_lines_go_and_too_much_loss_rejects(spark):
    good = "\n".join(f"line{i} holds{i} several{i} plain{i} words{i} of{i} prose{i}." for i in range(12))
    menu = "home | news | sport | about | contact"
    rows = [(1, good + "\n" + menu), (2, good[:400] + "\n" + "\n".join([menu] * 40)), (3, good + "\nPlease enable JavaScript\nWIR VERWENDEN COOKIES"), (4, good + "\n" + "long " * 30 + "privacy policy.")]
    got = {r.doc_id: r for r in quality_rules.clean_lines(docs(spark, rows)).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].lost_lines == 1
    assert not got[2].kept
    assert got[3].clean_text == good and got[4].lost_lines == 0


def test_licences(spark):
    mit = next(t for i, _, t in license_scan.KNOWN if i == "MIT" and len(t) > 200)
    rows = [
        (1, mit), (2, mit.upper().replace("(c) YEAR HOLDER", "2020 Somebody Else")), (3, "Prose.\n  released under the mit LICENCE!\nMore."), (4, "Not a licence"),
        (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (8, mit + " and more"), (None, "All rights reserved"), (None, "Plain."), (9, "All rights reserved"), (9, "Plain."),
    ]
    rows += [(100 + i, text.replace("\n\n", "\n  ").replace('"', "'")) for i, (_, _, text) in enumerate(license_scan.KNOWN)]
    every = license_scan.scan_licenses(docs(spark, rows), license_scan.known_digests(spark)).collect()
    assert len(every) == len(rows)
    assert sorted((r.doc_id is None, r.whole_license or "") for r in every if r.doc_id in (None, 9)) == [(False, ""), (False, "Proprietary"), (True, ""), (True, "Proprietary")]
    got = {r.doc_id: r for r in every}
    assert [got[100 + i].whole_license for i in range(len(license_scan.KNOWN))] == [name for name, _, _ in license_scan.KNOWN]
    assert got[1].whole_license == got[2].whole_license == "MIT"
    assert got[3].whole_license is None and got[3].licenses == ["MIT"] and got[3].n_lines == 1
    assert all(got[i].licenses == [] and got[i].whole_license is None for i in (4, 5, 6))
    assert got[7].licenses == ["CC-BY-NC-4.0"] and got[7].policies == ["non-commercial"]
    assert got[8].whole_license is None
    assert license_scan.scan_licenses(docs(spark, []), license_scan.known_digests(spark)).count() == 0


def test_known_digest_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_BROADCAST", 0)
    got = license_scan.scan_licenses(docs(spark, [(1, "All rights reserved.")]), license_scan.known_digests(spark)).collect()
    assert got[0].licenses == ["Proprietary"]


def test_empty_and_null_pages(spark):
    rules = url_filter.prefix_rules(spark, RULES)
    got = url_filter.judge_urls(spark.createDataFrame([(None, None)], "page_id long, url string"), rules).first()
    assert (got.host, got.path, got.rule, got.verdict) == ("", "", None, "allow")
    assert url_filter.judge_urls(pages(spark, ["http://x.net/es/"]), rules.where(F.lit(False))).first().verdict == "allow"


def test_prose_that_mentions_a_phrase_stays(spark):
    line = "The harbour committee met in the old hall and spoke for hours about the quay, the boats and the weather; we revised our privacy policy last year"
    rows = [(1, "\n".join(f"{line} {i}" for i in range(6))), (2, "\n".join(["All rights reserved. Privacy policy"] * 3 + [f"{line} {i}" for i in range(6)]))]
    got = {r.doc_id: r for r in quality_rules.clean_lines(docs(spark, rows)).collect()}
    assert got[1].lost_lines == 0 and got[1].clean_text == rows[0][1]
    assert got[2].lost_lines == 3
