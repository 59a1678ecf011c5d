"""Bodies and markup, however broken."""

import html
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import pytest
from factweir.functions import markup
from factweir.plans import registry

from tests.oracle import same


@pytest.mark.parametrize(("page", "title", "text"), [
    ("", "", ""), ("plain", "", "plain"), ("<title> A  b </title><p>c</p>", "A b", "A b c"), ("<TITLE>x</TITLE><title>y</title>z", "x", "x y z"), ("<title>open", "open", "open"),
    ("a<b>c</b>d", "", "a c d"), ('<a title="x > y">z</a>', "", "z"), ("<a title='it\\'s > '>z</a>", "", "'>z"), ('<p class="open>text<p>more', "", "text more"), ("1 < 2 and 3<4", "", "1 < 2 and 3<4"), ("a<", "", "a<"), ("a<b", "", "a"), ("</", "", "</"),
    ("<script>if (a < b) '</p>';</script >x", "", "x"), ("<script>never closed <p>x", "", ""), ("<style>p>a{}</style>x<script/>y</script>z", "", "x z"), ("<scripty>x</scripty>", "", "x"), ("<script>a</scripty>b</script>c", "", "c"),
    ("<svg><svg>a</svg>b</svg>c", "", "c"), ("<svg/>a", "", "a"), ("<noscript>a<noscript/>b</noscript>c", "", "c"), ("<template>a", "", ""), ("<svg><script>x</svg></script></svg>y", "", "y"), ("</svg>a", "", "a"),
    ("a<!-- b > c -->d<!-->e", "", "a d"), ("a<!-- never", "", "a"), ("<!DOCTYPE html><?php x ?>a", "", "a"), ("&amp;lt; &eacute;&#233;&#xE9; &nbsp;x &copy &bogus;", "", "&lt; ééé x © &bogus;"), ("a&amp;<b>amp;</b>", "", "a& amp;"),
])
def test_worked_pages(page, title, text):
    assert markup.visible(page) == (title, text)


class Plain(HTMLParser):
    """Text between tags by the standard library, for pages whose elements are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in markup.RAW + markup.HIDDEN
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in markup.RAW + markup.HIDDEN
        self.out.append(" ")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    def handle_entityref(self, name):
        self.handle_data(html.unescape(f"&{name};"))

    def handle_comment(self, data):
        self.out.append(" ")


def test_closed_pages_against_the_standard_library():
    rng = random.Random(1)

    def made(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["words", "a b", "&eacute;t", "<!-- no > -->", "<br/>", "", "&lt;"])
        tag = rng.choice(["p", "div", "B", "noscript", "svg", "script", "h1"])
        inner = "var x = '<p>';" if tag == "script" else "".join(made(depth - 1) for _ in range(rng.randint(0, 3)))
        attrs = rng.choice(["", ' class="a>b"', " id='x' hidden", ' href="/x?a=1&amp;b=2"'])
        return f"<{tag}{attrs}>{inner}</{tag}>"

    for _ in range(500):
        page = "".join(made(4) for _ in range(4))
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert markup.visible(page)[1] == re.sub(r"\s+", " ", "".join(plain.out)).strip(), page


@pytest.mark.parametrize("part", ["<", "<a ", "<a '", '<a "', "<a b='", "<!--", "<script>", "<svg>", "&amp;", "<svg></svg>", "<p>x", "</", "<a b=\"c\">"])
def test_work_grows_with_the_length(part):
    def took(n):
        began = time.perf_counter()
        markup.visible(part * n)
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 5.0


@pytest.mark.parametrize(("body", "kind", "text"), [
    (b"", None, ""), ("é".encode(), None, "é"), (b"\xe9", None, "�"), (b"\xe9", "text/plain; charset=latin-1", "é"), (b"\xe9", "text/html; charset=nope", "�"), (b"\xef\xbb\xbfa", "text/html; charset=utf-16", "a"),
    ("né".encode("utf-16"), None, "né"), (b"\xfe\xff\x00a", None, "a"), (b"\xff\xfe\x00\x00a\x00\x00\x00", None, "a"), (b'<meta charset="windows-1252">\x80', None, '<meta charset="windows-1252">€'), (b"<?xml version='1.0' encoding='iso-8859-1'?>\xe9", "text/xml", "<?xml version='1.0' encoding='iso-8859-1'?>é"),
    (b" " * 3000 + b'<meta charset="latin-1">\xe9', None, " " * 3000 + '<meta charset="latin-1">�'), (b"\xe9", "text/html; charset=base64", "�"), (b"a\x00b", "", "a\x00b"), (b"<meta name=a content='text/html; charset=ISO-8859-15'>\xa4", None, "<meta name=a content='text/html; charset=ISO-8859-15'>€"),
])
def test_bodies(body, kind, text):
    assert markup.decoded(body, kind) == text


@pytest.mark.parametrize(("page", "text"), [("a &amp&copy; &AMP; b&amp", "a &amp© & b&amp"), ("&#38;&#x26; &#38 &notit; &bogus;", "&& &#38 &notit; &bogus;"), ("<title>x&amp</title>&lt;", "x&amp <")])
def test_only_closed_entities(page, text):
    assert markup.visible(page, closed=True)[1] == text


def test_page_text_of_titles_cut_within_an_entity_matches_sql(spark, tmp_path):
    rows = [(1, "<title>A&amp;&amp</title><p>b &copy; c&amp</p>"), (2, "<title>x</title>y")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(registry.queries()["page_text"](spark, str(tmp_path)), con, registry.oracle_sql()["page_text"])
