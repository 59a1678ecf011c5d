"""What came back from the web, as tables: redirects, admission, stand-in pages, captures, links to reports, prose in
embedded data. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.functions import address, kernels, text, url
from factweir.functions import patterns as p
from factweir.functions.figures import says
from factweir.shipping import ship

#: Hops that are followed; captures of a page that are tried; characters of a page that are compared
#: with its host's probe page, and how alike they may be; links of a page that are followed.
MOST_HOPS, MOST_CAPTURES, PROBE_CHARS, PROBE_ALIKE, LINKS_A_PAGE = 5, 3, 3000, 90.0, 2
#: Visible text from which embedded data isn't asked; prose of one island and of a page.
SHELL_TEXT, ISLAND_CHARS, PAGE_CHARS, LEAST_PROSE = 2000, 40_000, 200_000, 25
#: Answers that mean an archive is down rather than without a capture.
ARCHIVE_DOWN = (429, 500, 502, 503, 504, 520, 521, 522, 523, 524)


def follow_redirects(urls: DataFrame, hops: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """urls(id, url) to id, url, final_url, path (the urls that redirected, in order) and error.

    hops(url, location): where a url redirects to, relative or absolute; without a location it doesn't. At most `most`
    hops are followed; a url that comes again ends its chain. error: `too many redirects`, `redirect loop` or
    `not allowed` (a url on the way that isn't public), with no final url. Of several locations of a url the least
    counts. Each hop is an equi-join with a table that holds a url once, so a url that many lead to can be split.
    """
    once = hops.where("url IS NOT NULL AND location IS NOT NULL AND location <> ''").groupBy("url").agg(F.min("location").alias("location"))
    once = once.select(F.col("url").alias("_from"), url.resolve(F.col("url"), F.col("location")).alias("_to"))
    once = once.withColumn("_open", F.coalesce(url.allowed_url(F.col("_to")), F.lit(False)))
    r = urls.select("id", "url", F.col("url").alias("_at"), F.array().cast("array<string>").alias("path"), F.when(F.coalesce(url.allowed_url(F.col("url")), F.lit(False)), F.lit(None).cast("string")).otherwise("not allowed").alias("error"))
    for hop in range(most + 1):
        r = r.join(once, (F.col("_at") == F.col("_from")) & F.col("error").isNull(), "left")
        moved, path = F.col("_to").isNotNull(), F.concat("path", F.array("_at"))
        wrong = F.when(F.array_contains(path, F.col("_to")), "redirect loop").when(F.lit(hop == most), "too many redirects").when(~F.col("_open"), "not allowed")
        r = r.select("id", "url", F.when(moved, F.col("_to")).otherwise(F.col("_at")).alias("_at"), F.when(moved, path).otherwise(F.col("path")).alias("path"), F.when(moved, wrong).otherwise(F.col("error")).alias("error"))
    return r.select("id", "url", F.when(F.col("error").isNull(), F.col("_at")).alias("final_url"), "path", "error")


def admission(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """urls(id, url) with `refused`: why a url isn't read; null if it may be.

    resolved(host, address): what names resolve to. A name with an address that isn't public, or with none, is refused;
    addresses in the url itself are judged as they are. Names are joined once each, whatever many urls share them.
    """
    closed = resolved.groupBy(F.lower("host").alias("_host")).agg(F.bool_and(F.coalesce(address.is_public(F.col("address")), F.lit(False))).alias("_open"))
    host = F.lower(F.regexp_extract(F.col("url"), url._NAMED_HOST, 1))
    r = urls.select("id", "url", host.alias("host"), F.coalesce(url.allowed_url(F.col("url")), F.lit(False)).alias("plain")).join(closed, F.col("host") == F.col("_host"), "left")
    own = address.is_public(F.col("host"), loose=True)
    why = F.when(~F.col("plain"), F.when(own == F.lit(False), "address not public").otherwise("url not allowed")).when(own.isNull() & F.col("_open").isNull(), "name not resolved").when(own.isNull() & ~F.col("_open"), "address not public")
    return r.select("id", "url", why.alias("refused"))


def is_block_page(title: Column, body: Column) -> Column:
    """A wall against robots or an outage page instead of the document."""
    body = F.coalesce(body, F.lit(""))
    return says(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(body, F.lit(600))), p.BLOCK_PAGE) & (F.length(body) < 5000)


def capture_list(answers: DataFrame, most: int = MOST_CAPTURES) -> DataFrame:
    """answers(url, status, body) of a capture index to url, place (from 1, newest first), stamp.

    The body is a JSON array of arrays whose first row names the fields of the others; rows without a stamp of digits
    are left out, as are bodies that are no such array. The `most` newest are kept.
    """
    rows = F.from_json("body", "array<array<string>>")
    head = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
    at = F.greatest(F.array_position(head, "timestamp"), F.lit(1)).cast("int")
    stamps = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.get(r, at - 1))
    good = F.reverse(F.filter(stamps, lambda s: F.coalesce(F.regexp_like(s, F.lit("^[0-9]+$")), F.lit(False))))
    found = answers.where("status = 200").select("url", F.posexplode(F.slice(good, 1, most)).alias("at", "stamp"))
    return found.select("url", (F.col("at") + 1).alias("place"), "stamp")


def nearest_capture(answers: DataFrame) -> DataFrame:
    """answers(url, status, body) of an availability service to url, place 1 and stamp of the capture it names."""
    closest = F.from_json("body", "struct<archived_snapshots:struct<closest:struct<available:boolean,status:string,timestamp:string>>>")["archived_snapshots"]["closest"]
    c = answers.where("status = 200").select("url", closest.alias("c"))
    fits = F.col("c.available") & (F.coalesce("c.status", F.lit("200")) == "200") & F.col("c.timestamp").rlike("^[0-9]+$")
    return c.where(fits).select("url", F.lit(1).alias("place"), F.col("c.timestamp").alias("stamp"))


def first_capture(captures: DataFrame, copies: DataFrame) -> DataFrame:
    """Per url of captures(url, place, stamp): outcome, used (the stamp) and tried, an array of (stamp, result).

    copies(url, stamp, http, status, title, text): what each capture holds and how a reader judged it (`ok` or why
    not). Captures are tried in order until one is ok; a block page is passed over; an archive that is down ends the
    search. outcome: used, unusable, rate_limited or unavailable. A url has a few captures, which meet in one row.
    """
    c = captures.join(copies, ["url", "stamp"], "left")
    down = F.when(F.col("http") == 429, "rate_limited").when(F.col("http").isNull() | F.col("http").isin(*ARCHIVE_DOWN), "unavailable")
    result = F.when(down.isNotNull(), down).when(is_block_page(F.col("title"), F.col("text")), "block page").otherwise(F.coalesce("status", F.lit("error")))
    listed = c.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("place", "stamp", result.alias("result"), down.isNotNull().alias("down")))).alias("all"))
    ends = F.filter("all", lambda x: (x["result"] == "ok") | x["down"])
    last = F.coalesce(F.get(ends, F.lit(0))["place"], F.lit(2**31 - 1))
    t = listed.select("url", F.filter("all", lambda x: x["place"] <= last).alias("t"), F.get(ends, F.lit(0)).alias("end"))
    outcome = F.when(F.col("end.result") == "ok", "used").when(F.col("end.down"), F.col("end.result")).otherwise("unusable")
    return t.select("url", outcome.alias("outcome"), F.when(F.col("end.result") == "ok", F.col("end.stamp")).alias("used"), F.transform("t", lambda x: F.struct(x["stamp"].alias("stamp"), x["result"].alias("result"))).alias("tried"))


def probe_matches(pages: DataFrame, probes: DataFrame, alike: float = PROBE_ALIKE) -> DataFrame:
    """pages(page_id, site, text) that look like what their site answers to a made-up path: page_id and ratio.

    probes(site, text), one for each site (the least text of several). The first PROBE_CHARS characters are compared.
    Lengths and counts of letters decide most pairs; only the rest are compared letter by letter. A site of many pages
    is split in the join, as a probe is one row.
    """
    ship(pages.sparkSession)
    one = probes.where("text <> ''").groupBy("site").agg(F.min(F.left("text", F.lit(PROBE_CHARS))).alias("probe"))
    both = pages.select("page_id", "site", F.left(F.coalesce("text", F.lit("")), F.lit(PROBE_CHARS)).alias("head")).join(one, "site")
    a, b = F.length("head"), F.length("probe")
    near = both.where(200 * F.least(a, b) >= alike * (a + b)).withColumn("ratio", kernels.ratio_from(alike)("head", "probe"))
    return near.where(F.col("ratio") >= alike).select("page_id", "ratio")


def report_links(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to page_id, place (from 1, best first), link, label, year, full, summary.

    Links to PDF files whose name or label names a disclosure, absolute, without fragment, the first of each address.
    The newest comes first, then what isn't a summary, then full editions, then as they stand on the page.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a>"), F.lit(0))
    a = pages.select("page_id", "url", F.posexplode(anchors).alias("seq", "a"))
    part = lambda i: F.regexp_extract("a", r"(?is)<a\b[^>]*?\bhref\s*=\s*([\"'])(.*?)\1[^>]*>(.*?)</a>", i)
    href = F.replace(F.trim(part(2)), F.lit("&amp;"), F.lit("&"))
    label = text.squash(F.regexp_replace(part(3), r"<[^>]+>", " "))
    a = a.select("page_id", "seq", href.alias("href"), label.alias("label"), url.resolve(F.col("url"), href).alias("link"))
    skipped = (F.col("href") == "") | F.regexp_like("href", F.lit("^(?:#|mailto:|javascript:|data:)"))
    path = url.path_of(F.col("link"))
    a = a.where(~skipped & F.regexp_like("link", F.lit("(?i)^https?:")) & F.endswith(F.lower(path), F.lit(".pdf")))
    named = F.concat(F.regexp_extract(path, "[^/]*$", 0), F.lit(" "), F.col("label"))
    a = a.withColumn("named", named).where(says(F.col("named"), p.REPORT_LINK))
    years = F.transform(F.regexp_extract_all("named", F.lit(p.LINK_YEAR), F.lit(1)), lambda y: y.cast("int"))
    a = a.select("page_id", "seq", "link", F.left("label", F.lit(200)).alias("label"), F.array_max(years).alias("year"), says(F.col("named"), p.FULL_EDITION).alias("full"), says(F.col("named"), p.SUMMARY_EDITION).alias("summary"))
    first = a.groupBy("page_id", "link").agg(F.min(F.struct("seq", "label", "year", "full", "summary")).alias("f")).select("page_id", "link", "f.*")
    order = [F.desc(F.coalesce("year", F.lit(0))), "summary", ~F.col("full"), "seq"]
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).alias("place"), "link", "label", "year", "full", "summary")


def pick_links(links: DataFrame, most: int = LINKS_A_PAGE) -> DataFrame:
    """The links of `report_links` that are followed, at most `most` a page: page_id, place, link.

    Once a full edition is taken, summaries of its year and whatever is older are passed over.
    """
    item = F.struct("place", "link", F.coalesce("year", F.lit(0)).alias("year"), F.col("year").isNull().alias("undated"), "summary")
    listed = links.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("all"))  # the report links of one page

    def step(taken: Column, x: Column) -> Column:
        full = F.filter(taken, lambda c: ~c["summary"])
        same = F.exists(full, lambda c: x["summary"] & (c["year"] == x["year"]) & (c["undated"] == x["undated"]))
        older = F.exists(full, lambda c: (c["year"] > 0) & (x["year"] > 0) & (x["year"] < c["year"]))
        return F.when((F.size(taken) < most) & ~same & ~older, F.concat(taken, F.array(x))).otherwise(taken)

    taken = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)
    return listed.select("page_id", F.explode(taken).alias("t")).select("page_id", "t.place", "t.link")


def registry_company(searches: DataFrame, least: float = 85.0) -> DataFrame:
    """searches(id, name, html) of a registry to id, path, listed: the entry whose name is most alike, the first of
    equals; entries match with an equal core name or a ratio of `least` over the sets of words."""
    ship(searches.sparkSession)
    found = F.regexp_extract_all("html", F.lit("(?i)" + p.COMPANY_ENTRY), F.lit(0))
    e = searches.select("id", text.core_name(F.col("name")).alias("core"), F.posexplode(found).alias("seq", "m"))
    part = lambda i: F.regexp_extract("m", "(?i)" + p.COMPANY_ENTRY, i)
    e = e.select("id", "core", "seq", part(1).alias("path"), F.trim(part(2)).alias("listed"))
    e = e.withColumn("other", text.core_name(F.col("listed"))).where("core <> '' AND other <> ''")
    e = e.withColumn("score", F.when(F.col("core") == F.col("other"), 100.0).otherwise(kernels.token_set_ratio("core", "other"))).where(F.col("score") >= least)
    best = e.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("order"), "seq", "path", "listed")).alias("b"))
    return best.select("id", "b.path", "b.listed")


def registry_report(pages: DataFrame, base: str) -> DataFrame:
    """pages(id, html) of a registry's company to id, link, label: the newest report that can be read: the current one
    unless it is locked, else the newest of the archive."""
    block = F.regexp_extract("html", "(?i)" + p.RECENT_BLOCK, 1)
    now = F.when((block != "") & ~block.contains("report_locked_block"), block)
    click = lambda i: F.regexp_extract(now, "(?i)" + p.RECENT_REPORT, i)
    old = F.transform(F.regexp_extract_all("html", F.lit("(?i)" + p.ARCHIVED_REPORT), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, "(?i)" + p.ARCHIVED_REPORT, 2).cast("int").alias("year"), F.regexp_extract(m, "(?i)" + p.ARCHIVED_REPORT, 1).alias("path")))
    r = pages.select("id", click(1).alias("click"), F.trim(click(2)).alias("label"), F.array_max(old).alias("old"))
    have = F.coalesce(F.col("click") != "", F.lit(False))
    named = F.when(have, F.when(F.col("label") == "", "most recent report").otherwise(F.col("label"))).otherwise(F.concat(F.col("old.year").cast("string"), F.lit(" report (archived)")))
    return r.where(have | F.col("old").isNotNull()).select("id", url.resolve(F.lit(base), F.when(have, F.col("click")).otherwise(F.col("old.path"))).alias("link"), named.alias("label"))


def json_strings(raw: Column) -> Column:
    """The string values of a JSON text, depth first, which is as they stand in it; null if it isn't JSON.

    Keys are left out. VARIANT decides whether the text is JSON; it sorts keys, so order is read off the text.
    """
    hidden = F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.filter(F.regexp_extract_all(hidden, F.lit(r'"[^"]*"\s*:?'), F.lit(0)), lambda t: ~F.endswith(t, F.lit(":")))
    plain = F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\")))
    return F.when(F.try_parse_json(raw).isNotNull(), F.from_json(F.concat(F.lit("["), F.array_join(plain, ","), F.lit("]")), "array<string>"))


def embedded_prose(html: Column) -> Column:
    """Prose of a page's data islands, each text once, in order: strings of several words, no addresses or markup.

    Islands are scripts of JSON kinds; those of the whole site are left out, and of a framework's own only the page's
    part counts. Broken JSON has none. An island gives no more once it has ISLAND_CHARS, a page once it has PAGE_CHARS.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>"), F.lit(0))
    attribute = lambda s, name: F.regexp_extract(F.regexp_extract(s, r"(?is)^<script\b([^>]*)>", 1), rf"(?i)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = lambda s, name: F.regexp_replace(F.regexp_replace(attribute(s, name), r"^[^=]*=\s*", ""), "^[\"']|[\"']$", "")
    own = lambda s: value(s, "id") == "__NEXT_DATA__"
    kind = lambda s: F.trim(F.lower(F.regexp_extract(value(s, "type"), "^[^;]*", 0)))
    used = F.filter(scripts, lambda s: own(s) | (kind(s).isin("application/json", "application/ld+json") & ~says(value(s, "id"), p.SITE_WIDE_ISLAND)))

    def strings(s: Column) -> Column:
        raw = F.regexp_replace(s, r"(?is)^<script\b[^>]*>|</script\s*>$", "")
        page = F.when(own(s), F.coalesce(F.get_json_object(raw, "$.props.pageProps"), raw)).otherwise(raw)
        bare = F.transform(F.coalesce(json_strings(page), F.array().cast("array<string>")), lambda t: F.regexp_replace(t, rf"^{text.BLANKS}|{text.BLANKS}$", ""))
        good = lambda t: (F.length(t) >= LEAST_PROSE) & t.contains(" ") & ~F.regexp_like(t, F.lit("(?i)" + p.NO_PROSE)) & ~F.regexp_like(t, F.lit(r"^[{\[<]"))
        return F.transform(F.filter(bare, good), lambda t: F.regexp_replace(t, text.BLANKS, " "))

    listed = F.flatten(F.transform(used, lambda s, i: F.transform(strings(s), lambda t: F.struct(i.alias("island"), t.alias("t")))))
    start = F.struct(F.lit(-1).alias("island"), F.lit(0).alias("own"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        held = F.when(a["island"] == x["island"], a["own"]).otherwise(F.lit(0))
        new = (held < ISLAND_CHARS) & (a["total"] <= PAGE_CHARS) & ~F.array_contains(a["out"], x["t"])
        n = F.when(new, F.length(x["t"])).otherwise(F.lit(0))
        return F.struct(x["island"].alias("island"), (held + n).alias("own"), (a["total"] + n).alias("total"), F.when(new, F.concat(a["out"], F.array(x["t"]))).otherwise(a["out"]).alias("out"))

    return F.aggregate(listed, start, step)["out"]


def with_prose(visible: Column, prose: Column) -> Column:
    """The visible text, with prose of embedded data that it doesn't hold after it if it is short."""
    extra = text.squash(F.array_join(F.filter(prose, lambda t: ~F.contains(visible, t)), " "))
    return F.when((F.length(visible) < SHELL_TEXT) & (F.size(prose) > 0), F.left(F.trim(F.concat_ws(" ", visible, extra)), F.lit(PAGE_CHARS) + F.length(visible))).otherwise(visible)
