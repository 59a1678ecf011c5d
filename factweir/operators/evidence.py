"""Sources and quotes: deduplication, chunk ranking, budgets, and finding quotes in source texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factweir.functions import kernels, text, url
from factweir.shipping import ship, ship_for_texts

#: Characters of a quote's normal form, and letters and digits it needs.
MIN_QUOTE, MAX_QUOTE, MIN_SKELETON = 20, 600, 14

#: Quotes up to which their keys are broadcast; beyond it Spark joins as it sees fit.
MAX_BROADCAST_QUOTES = 100_000


def unique_urls(sources: DataFrame) -> DataFrame:
    """The first source of each normal URL of a run."""
    key = url.normal_url(F.col("url"))
    return sources.withColumn("normal_url", key).groupBy("run_id", "normal_url").agg(F.min("source_id").alias("source_id"))


def mark_duplicates(sources: DataFrame) -> DataFrame:
    """Per source of a run: sha256 of its text, and the first source with the same text if it isn't the first.

    The minimum is combined before the shuffle, so a text repeated everywhere is no bottleneck.
    """
    hashed = sources.select("run_id", "source_id", F.sha2("text", 256).alias("sha"))
    first = hashed.groupBy("run_id", "sha").agg(F.min("source_id").alias("first"))
    return hashed.join(first, ["run_id", "sha"]).select("run_id", "source_id", "sha", F.when(F.col("first") < F.col("source_id"), F.col("first")).alias("duplicate_of"))


def verify_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes(quote_id, run_id, source_id, quote) found in the sources(run_id, source_id, text) of their run, by
    letters and digits. The cited source comes first, then the first other. See `find_quotes`."""
    return _found(quotes, sources, ["run_id"])


def find_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes(quote_id, source_id, quote) found in any of sources(source_id, text), by letters and digits.

    A quote's key is one anchor of its letters and digits, which all texts that hold the quote have among their
    anchors, so only texts that share it are searched. Quotes too short for a long anchor have a shorter one.
    Method: exact if the normal form is there as well, else loose. A null source_id comes after all others.
    """
    return _found(quotes, sources, [])


def candidate_sources(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, source_id): sources(source_id, text) that share an anchor with quotes(quote_id, quote)."""
    asked = _asked(quotes.withColumn("source_id", F.lit(None).cast("long")), [])
    return _sharing_anchor(asked, sources.select("source_id", "text"), []).select("quote_id", F.col("found_in").alias("source_id")).where("source_id IS NOT NULL").distinct()


def _asked(quotes: DataFrame, within: list[str]) -> DataFrame:
    """The quotes that are long enough and not too long, with their letters and digits and normal form."""
    n, sk = F.length(F.trim(text.normal_text(F.col("quote")))), text.skeleton(F.col("quote"))
    q = quotes.where(n.between(MIN_QUOTE, MAX_QUOTE)).select("quote_id", *within, F.col("source_id").alias("cited"), sk.alias("sk"), text.normal_text(F.col("quote")).alias("norm"))
    return q.where(F.length("sk") >= MIN_SKELETON)


def _long() -> Column:
    return F.length("sk") >= sum(kernels.LONG_ANCHORS) - 1


def _sizes(q: DataFrame) -> Row:
    return q.agg(F.count(F.lit(1)).alias("n"), F.count_if(_long()).alias("long")).first()


def _few(sizes: Row) -> bool:
    return sizes["n"] <= MAX_BROADCAST_QUOTES


def _sharing_anchor(q: DataFrame, s: DataFrame, within: list[str], sizes: Row | None = None) -> DataFrame:
    """(quote_id, within, found_in, digest): the texts that share the columns `within` and an anchor."""
    spark = q.sparkSession
    ship_for_texts(spark)
    sizes = sizes or _sizes(q)
    pairs = None
    for some, anchors, wanted in ((sizes["long"], kernels.long_anchors, _long()), (sizes["n"] - sizes["long"], kernels.short_anchors, ~_long())):
        if some:
            keys = q.where(wanted).select("quote_id", *within, F.array_min(anchors("sk")).alias("anchor"))
            held = s.select(*within, F.col("source_id").alias("found_in"), F.xxhash64("text").alias("digest"), F.explode(anchors(text.skeleton(F.col("text")))).alias("anchor"))
            found = held.join(F.broadcast(keys) if _few(sizes) else keys, [*within, "anchor"]).select("quote_id", *within, "found_in", "digest")
            pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = q.select("quote_id", *within, F.col("cited").alias("found_in"), F.lit(0).cast("long").alias("digest"))
    return pairs


def _found(quotes: DataFrame, sources: DataFrame, within: list[str]) -> DataFrame:
    """Quotes in the texts that share the columns `within` and an anchor."""
    q = _asked(quotes, within)
    sizes = _sizes(q)
    hinted = lambda df: F.broadcast(df) if _few(sizes) else df
    s = sources.select(*within, "source_id", "text")
    pairs = _sharing_anchor(q, s, within, sizes)
    texts = s.select(F.col("source_id").alias("id"), F.xxhash64("text").alias("d"), *[F.col(c).alias(f"_{c}") for c in within], "text")
    same = (F.col("digest") == F.col("d")) & F.col("found_in").eqNullSafe(F.col("id"))
    for c in within:
        same = same & (F.col(c) == F.col(f"_{c}"))
    both = pairs.distinct().join(texts, same).select("quote_id", "found_in", "text")
    hits = both.join(hinted(q), "quote_id").where(F.contains(text.skeleton(F.col("text")), "sk"))
    method = F.when(F.contains(text.normal_text(F.col("text")), "norm"), "exact").otherwise("loose")
    other = F.coalesce(F.col("found_in") != F.col("cited"), F.lit(True))
    best = F.min(F.struct(other.alias("other"), F.col("found_in").isNull().alias("unnamed"), "found_in", method.alias("method")))
    return hits.groupBy("quote_id").agg(best.alias("b")).select("quote_id", "b.found_in", "b.method")


def ranked_chunks(sources: DataFrame, size: int = 1100, scores: Callable[[Column], Column] = text.chunk_scores) -> DataFrame:
    """Chunks of each source with their scores: source_id, i, start, end, quant, qual.

    scores: struct(quant, qual) of a chunk's text. The chunks come cut out of one pass over a text; the whole text
    isn't carried along with each.
    """
    ship_for_texts(sources.sparkSession)
    c = sources.select("source_id", kernels.chunks_of(size)("text").alias("chunks")).select("source_id", F.posexplode("chunks").alias("i", "c"))
    return c.select("source_id", "i", "c.start", "c.end", scores(F.col("c.body")).alias("s")).select("source_id", "i", "start", "end", "s.quant", "s.qual")


def relevance(chunks: DataFrame, n: int = 8) -> DataFrame:
    """Per source: qual, the sum of its n best positive qual scores, and relevance, that of quant and twice of qual."""
    top = lambda c: F.aggregate(F.slice(F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.col(c).cast("double"))), asc=False), 1, n), F.lit(0.0), lambda a, x: a + x)
    best = chunks.groupBy("source_id").agg(top("quant").alias("quant"), top("qual").alias("qual"))
    return best.select("source_id", "qual", (F.col("quant") + 2 * F.col("qual")).alias("relevance"))


def take_within(chunks: DataFrame, score: str, budget: int) -> DataFrame:
    """Chunks of each source in score order while they fit the budget; what doesn't fit is skipped, not an end.

    A fold over the chunks of one source, with the scores and lengths alone.
    """
    items = F.array_sort(F.collect_list(F.when(F.col(score) > 0, F.struct((-F.col(score).cast("double")).alias("order"), "i", (F.col("end") - F.col("start")).alias("size")))))
    fits = lambda a, x: a["used"] + x["size"] <= budget
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))
    step = lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["size"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.concat(a["taken"], F.array(x["i"]))).otherwise(a["taken"]).alias("taken"))
    return chunks.groupBy("source_id").agg(F.aggregate(items, start, step).alias("t")).select("source_id", "t.used", F.array_sort("t.taken").alias("taken"))


def _rare_grams(names: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(id, core, gram): the rarest distinct letter pairs of each name, one more than its allowed edits can touch.

    A ratio of `threshold` leaves (200 - 2 * threshold) / 200 of the two lengths to insert and delete, and an edit
    touches two pairs at most.
    """
    length = F.length("core")
    edits = F.floor((100 - threshold) / 100 * (length + F.floor(length * (200 - threshold) / threshold)))
    grams = names.select("id", "core", F.explode(_pairs("core")).alias("gram")).join(counts, "gram")
    ranked = grams.groupBy("id", "core").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))  # the letters of one name
    return ranked.select("id", "core", F.explode(F.slice("grams", 1, (2 * edits + 1).cast("int"))).alias("g")).select("id", "core", "g.gram")


def _pairs(core: str) -> Column:
    padded = F.concat(F.lit("^"), F.col(core), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def similar_names(names: DataFrame, registry: DataFrame, threshold: float = 92.0, margin: float = 2.0) -> DataFrame:
    """names(id, name) to the registry entry whose core name is most alike; ambiguous within `margin`.

    Prefix filtering over letter pairs finds every pair that can reach the threshold: if the names' pairs are
    ordered by how rare they are, one of the first few of each must agree. Ratios are only worked out for names
    that share one and whose lengths allow the threshold. Names without letters or digits match nothing.
    """
    ship(names.sparkSession)
    a = names.select("id", text.core_name(F.col("name")).alias("core")).where("core <> ''")
    b = registry.select("id", text.core_name(F.col("name")).alias("core")).where("core <> ''")
    counts = a.unionByName(b).select(F.explode(_pairs("core")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    left = _rare_grams(a, counts, threshold)
    right = _rare_grams(b, counts, threshold).withColumnsRenamed({"id": "entry", "core": "other"})
    la, lb = F.length("core"), F.length("other")
    pairs = left.join(right, "gram").where(200 * F.least(la, lb) >= threshold * (la + lb)).select("id", "core", "entry", "other").distinct()
    scored = pairs.withColumn("score", kernels.indel_ratio("core", "other")).where(F.col("score") >= threshold)
    by = Window.partitionBy("id").orderBy(F.desc("score"), "entry")
    top = scored.withColumns({"place": F.row_number().over(by), "next": F.lead("score").over(by)}).where("place = 1")
    return top.select("id", "entry", "score", F.coalesce(F.col("next") >= F.col("score") - margin, F.lit(False)).alias("ambiguous"))


def host_failures(sources: DataFrame, status: Column, n: int = 10) -> DataFrame:
    """The n hosts with most failed sources."""
    s = sources.select(url.host_of(F.col("url")).alias("host"), status.alias("status"))
    got = s.groupBy("host").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("status") == "dead").alias("dead"))
    return got.where("failed > 0").orderBy(F.desc("failed"), "host").limit(n)


def page_order(pages: DataFrame, wanted: str, keep: int = 30, quiet: int = 40, scan: int = 120) -> DataFrame:
    """Pages of a long document that are read and kept: outline hits, then the last 40 percent backwards,
    then the rest; stops after `scan` pages or `quiet` pages without a hit since the last one.

    pages(doc_id, page, n_pages, in_outline, text).
    """
    late = F.col("page") >= F.floor(F.col("n_pages") * 0.6)
    group = F.when(F.col("in_outline"), 0).when(late, 1).otherwise(2)
    by = Window.partitionBy("doc_id")
    p = pages.withColumn("ord", F.row_number().over(by.orderBy(group, F.when(late & ~F.col("in_outline"), -F.col("page")).otherwise(F.col("page")))))
    p = p.withColumn("hit", F.regexp_like("text", F.lit(wanted))).where(F.col("ord") <= scan)
    upto = by.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("last_hit", F.max(F.when(F.col("hit"), F.col("ord"))).over(upto))
    stop = F.min(F.when(F.col("ord") - F.col("last_hit") > quiet, F.col("ord"))).over(by)
    p = p.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("ord") < F.col("stop"))).where("hit")
    return p.withColumn("nth", F.row_number().over(by.orderBy("ord"))).where(F.col("nth") <= keep).select("doc_id", "page", "nth")


def first_candidates(candidates: DataFrame, priority: Column, keep: int = 12) -> DataFrame:
    """The `keep` best candidates of each run with their place: by priority, then in the order they came."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(priority.desc(), "source_id"))
    return candidates.withColumn("place", place).where(F.col("place") <= keep)


def deferral(sources: DataFrame, transient: Column, read: Column) -> DataFrame:
    """Per run: whether all its sources failed for reasons that may go away, whether any was read, and its filings."""
    return sources.groupBy("run_id").agg(F.bool_and(transient).alias("all_transient"), F.bool_or(read).alias("any_read"), F.count_if(F.col("origin") == "edgar").alias("filings"))
