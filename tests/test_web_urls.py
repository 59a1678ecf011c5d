"""Addresses against the standard library; links and redirects against plain versions."""

import ipaddress
import random
import socket
from urllib.parse import urldefrag, urljoin

import pytest
from factweir.functions import address, url
from pyspark.sql import functions as F


def mapped(text):
    ip = ipaddress.ip_address(text.strip("[]").split("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip


def test_ranges_are_sorted_and_apart():
    r = address.ranges()
    assert all(a <= b for a, b in r) and all(x[1] < y[0] for x, y in zip(r, r[1:], strict=False))


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(6)
    nets = [ipaddress.ip_network(n) for n in (*address.CLOSED, *address.OPEN_WITHIN)]
    texts = []
    for net in nets:
        low, high = int(net.network_address), int(net.broadcast_address)
        kind = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        for x in (low, high, low - 1, high + 1, rng.randint(low, high)):
            if 0 <= x < 2 ** (32 if net.version == 4 else 128):
                texts.append(str(kind(x)))
    for _ in range(600):
        six = ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 16, 80, 96, 120]))
        texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))), str(six), six.exploded.upper(), f"[{six}]", f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}"]
    odd = ["", " ", None, "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1:2:3", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "g::", "12345::", "fe80::1%eth0", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7:8", "host.example", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    rows = spark.createDataFrame([(t,) for t in texts + odd], "t string").select("t", address.address_value(F.col("t")).alias("v"), address.is_public(F.col("t")).alias("p")).collect()
    for r in rows:
        try:
            ip = mapped(r.t)
        except (ValueError, AttributeError):
            assert r.v is None and r.p is None, r.t
            continue
        assert r.v == f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}", r.t
        assert r.p == (ip.is_global and not ip.is_multicast), r.t


def test_what_resolvers_read_as_an_address(spark):
    rng = random.Random(8)
    forms = ["127.1", "0x7f000001", "2130706433", "0177.0.0.1", "10.256", "1.2.65536", "1.16777216", "0x", "08.1.1.1", "4294967296", "4294967295", "0xffffffffff", "1.2.3.4.5", "a.b", "1..2", "0x0A.1", "999999999999999999999", "00000000000000000001"]
    forms += [".".join(rng.choice([str, hex, lambda x: "0" + oct(x)[2:]])(rng.randrange(300)) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in forms], "t string").select("t", address.address_value(F.col("t"), loose=True).alias("v")).collect()
    for r in rows:
        try:
            want = "0" * 20 + "ffff" + socket.inet_aton(r.t).hex()
        except OSError:
            want = None
        assert r.v == want or (want and len(r.t) >= 12 and r.v is None), (r.t, r.v, want)


@pytest.mark.parametrize(("link", "ok"), [
    ("https://example.com/a", True), ("HTTP://Example.COM", True), ("http://8.8.8.8:80/", True), ("http://[2606:4700::1111]/x", True), ("https://user:pw@example.com:443/", True),
    ("ftp://example.com/", False), ("http://example.com:8080/", False), ("http://localhost/", False), ("http://a.internal", False), ("http://10.1.2.3/", False), ("http://[::1]/", False), ("http://[::ffff:10.0.0.1]:80/", False),
    ("http://127.1/", False), ("http://2130706433/", False), ("http://0x7f.0.0.1/", False), ("http://user@127.0.0.1/", False), ("http://a@b@127.0.0.1/", False), ("http://[zz]/", False), ("http:///x", False), ("", False), ("no url", False),
    ("http://100.64.1.1/", False), ("http://192.0.0.9/", True), ("http://999.1.1.1/", True), ("http://example.com:/", True),
])
def test_admission_of_urls(spark, link, ok):
    assert spark.range(1).select(url.allowed_url(F.lit(link)).alias("a")).first().a is ok


def test_links_against_the_standard_library(spark):
    bases = ["http://a.example/b/c/d.html?q=1", "http://a.example", "https://a.example/", "http://a.example/b/c/", "https://a.example/x/../y/z", "http://a.example/p?x=/../y"]
    links = ["", "g", "./g", "g/", "/g", "//h.example/x", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "https://o.example/a/../b", "mailto:x@y.z", "/a//b/../c", "  g  ", "g?y/../x", "é/ü", "//h.example", "a:b"]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string").select("b", "x", url.resolve(F.col("b"), F.col("x")).alias("u")).collect()
    for r in rows:
        assert r.u == urldefrag(urljoin(r.b, r.x.strip()))[0], (r.b, r.x)
    odd = spark.createDataFrame([(None, "http://a/b"), ("http://a/b", None), (None, None)], "b string, x string").select(url.resolve(F.col("b"), F.col("x")).alias("u")).collect()
    assert [r.u for r in odd] == ["http://a/b", "http://a/b", ""]


def test_an_address_is_worked_out_once(spark):
    """However often its value is looked at, the text of an address is read in one place of the plan."""
    plan = spark.range(1).select(address.is_public(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1 and plan.count("){7}$") == 1
