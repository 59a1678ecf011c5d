"""What a reader with a budget gets of long sources: chunks by score, shares of a run's budget, passages for claims.

A choice of chunks is a fold over offers. Each pass offers the chunks with a positive score, best first, and has a
ceiling; an offer is taken if the chunk isn't yet and what was taken stays within the ceiling. Offers hold numbers
only, so a long text stays where it is. All of it runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweir.operators import filings

#: Characters of a chunk; chunks of a budget from which the first one is offered before all others.
CHUNK, TITLE_CHUNKS, SMALLEST_CHUNK = 1100, 4, 300
#: Passes of a choice as (score, share of the budget, score that brings the next chunk along).
PASSES = (("quant", 0.6, 10.0), ("qual", 1.0, None), ("both", 1.0, None))
#: Characters that each source of a run gets at least, and relevance beyond which more doesn't count.
FLOOR, RELEVANCE_MOST = 2500, 300.0
#: Verified claims from which no more are asked for, and characters of passages that are read for them.
CLAIMS_ENOUGH, CLAIMS_CHARS = 3, 24_000

_NONE, _CHUNKS = "array<int>", "array<struct<i:int,start:int,end:int,quant:double,qual:double>>"
_OFFERS = "array<struct<i:int,size:int,ceiling:int,follows:boolean>>"
_SALTS = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_size(budget: int) -> int:
    """Characters of a chunk for a reader with this budget: smaller ones for small budgets."""
    return min(CHUNK, max(SMALLEST_CHUNK, budget // 2))


def _size(chunk: Column) -> Column:
    return chunk["end"] - chunk["start"]


def _offer(i: Column, size: Column, ceiling: Column, follows: bool) -> Column:
    return F.struct(i.cast("int").alias("i"), size.cast("int").alias("size"), ceiling.cast("int").alias("ceiling"), F.lit(follows).alias("follows"))


def _pass(chunks: Column, past: Column, budget: Column, score: str, share: float, brings: float | None) -> Column:
    worth = (lambda c: c["quant"] + c["qual"]) if score == "both" else (lambda c: c[score])
    open_ = F.filter(chunks, lambda c: (worth(c) > 0) & ~F.array_contains(past, c["i"]))
    ordered = F.array_sort(F.transform(open_, lambda c: F.struct((-worth(c)).alias("order"), c["i"].alias("i"), _size(c).alias("size"))))
    ceiling = F.floor(budget * share)
    own = lambda o: _offer(o["i"], o["size"], ceiling, False)
    if brings is None:
        return F.transform(ordered, own)
    after = lambda o: F.when(-o["order"] >= brings, _size(F.get(chunks, o["i"] + 1)))
    return F.flatten(F.transform(ordered, lambda o: F.array(own(o), _offer(o["i"] + 1, after(o), ceiling, True))))


def _take(offers: Column, used: Column, taken: Column) -> Column:
    """(used, taken, fresh) after all offers; what follows a chunk is taken only if that chunk was just now."""

    def step(s: Column, o: Column) -> Column:
        fits = F.coalesce((s["used"] + o["size"] <= o["ceiling"]) & (~o["follows"] | s["fresh"]) & ~F.array_contains(s["taken"], o["i"]), F.lit(False))
        taken_ = F.struct((s["used"] + o["size"]).alias("used"), F.concat(s["taken"], F.array(o["i"])).alias("taken"), (~o["follows"]).alias("fresh"))
        return F.when(fits, taken_).otherwise(F.struct(s["used"].alias("used"), s["taken"].alias("taken"), (s["fresh"] & o["follows"]).alias("fresh")))

    return F.aggregate(offers, F.struct(used.cast("int").alias("used"), taken.cast(_NONE).alias("taken"), F.lit(False).alias("fresh")), step)


def _windows(chunks: Column, chosen: Column) -> Column:
    """First and last character of each stretch of adjacent chunks; chosen is sorted."""
    edge = lambda d: F.filter(chosen, lambda i: ~F.array_contains(chosen, i + d))
    pair = F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b"))
    return F.transform(pair, lambda p: F.struct(F.get(chunks, p["a"])["start"].alias("start"), F.get(chunks, p["b"])["end"].alias("end")))


def choose(chunks: DataFrame, wanted: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """Per source of wanted(source_id, length, budget): source_id, chosen (chunk numbers), windows (start, end).

    chunks(source_id, i, start, end, quant, qual), numbered from 0 without gaps. A source that fits its budget is
    read whole, with no chunk chosen. avoid(source_id, chosen): an earlier choice that nothing came of; other chunks
    are then taken, and the first is no longer offered before all others. Where less than half the budget is used,
    chunks are taken in order. A source's chunks meet in one row, 24 bytes for each thousand characters.
    """
    listed = chunks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end", F.col("quant").cast("double").alias("quant"), F.col("qual").cast("double").alias("qual")))).alias("c"))
    past = F.lit(None).cast(_NONE)
    rows = wanted.select("source_id", F.coalesce("length", F.lit(0)).alias("length"), "budget").join(listed, "source_id", "left")
    if avoid is not None:
        rows, past = rows.join(avoid.select("source_id", F.col("chosen").alias("_past")), "source_id", "left"), F.col("_past")
    rows = rows.select("source_id", "length", "budget", F.coalesce("c", F.array().cast(_CHUNKS)).alias("c"), F.coalesce(past, F.array().cast(_NONE)).alias("past"))
    c, past, budget = F.col("c"), F.col("past"), F.col("budget")
    title = F.when((budget >= TITLE_CHUNKS * CHUNK) & (F.size(past) == 0) & (F.size(c) > 0), F.array(_offer(F.lit(0), _size(F.get(c, F.lit(0))), budget, False))).otherwise(F.array().cast(_OFFERS))
    offers = F.concat(title, *[_pass(c, past, budget, *p) for p in PASSES])
    rest = F.transform(F.filter(c, lambda x: ~F.array_contains(past, x["i"])), lambda x: _offer(x["i"], _size(x), budget, False))
    first = _let(_take(offers, F.lit(0), F.array()), lambda s: F.when(s["used"] < F.floor(budget / 2), _take(rest, s["used"], s["taken"])).otherwise(s))
    chosen = F.when(F.col("length") <= budget, F.array().cast(_NONE)).otherwise(F.array_sort(first["taken"]))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("length").cast("int").alias("end")))
    found = rows.select("source_id", "length", "budget", "c", chosen.alias("chosen"))
    return found.select("source_id", "chosen", F.when(F.col("length") <= F.col("budget"), whole).otherwise(_windows(F.col("c"), F.col("chosen"))).alias("windows"))


def source_kinds(sources: DataFrame, n_qual: int = 3) -> DataFrame:
    """sources(run_id, source_id, url, final_url, title, origin, qual) with `filing` and `qualitative`.

    filing: the registry's or an annual report; qualitative: the n_qual other sources of a run with the most
    qualitative material, the smallest id first among equals.
    """
    annual = filings.is_annual_report(F.col("url"), F.col("title"), F.lit(None).cast("string"), F.col("origin"))
    s = sources.withColumn("filing", F.coalesce(filings.is_registry_host(F.col("url")), F.lit(False)) | F.coalesce(filings.is_registry_host(F.col("final_url")), F.lit(False)) | annual)
    able = ~F.col("filing") & (F.col("qual") > 0)
    place = F.row_number().over(Window.partitionBy("run_id", able).orderBy(F.desc("qual"), "source_id"))
    return s.withColumn("qualitative", F.coalesce(able & (place <= n_qual), F.lit(False)))


def allocate(sources: DataFrame, total: int, per_source: int, filing_most: int | None = None, qual_floor: int = 0) -> DataFrame:
    """sources(run_id, source_id, length, relevance, filing, qualitative) to run_id, source_id, budget.

    Every source gets a floor, qualitative ones a higher one, none more than its length, per_source or, for filings,
    filing_most. The rest of `total` rises like water in vessels as wide as the root of their relevance: sources with
    none come after all others and share alike. Vessels are sorted by how high they can be filled, so the level is
    read off running sums; it is rounded down to whole characters for each source.
    """
    most = F.least(F.col("length"), F.lit(per_source), *([F.when(F.col("filing"), F.lit(filing_most)).otherwise(F.lit(per_source))] if filing_most is not None else []))
    floor = F.when(F.col("qualitative"), F.lit(max(FLOOR, qual_floor))).otherwise(F.lit(FLOOR))
    s = sources.select("run_id", "source_id", most.cast("long").alias("most"), F.least(most, floor).cast("long").alias("base"), F.least(F.greatest(F.coalesce("relevance", F.lit(0.0)), F.lit(0.0)), F.lit(RELEVANCE_MOST)).alias("rel"))
    s = s.select("*", (F.col("most") - F.col("base")).alias("room"), (F.col("rel") > 0).alias("wanted"), F.when(F.col("rel") > 0, F.sqrt("rel")).otherwise(F.lit(1.0)).alias("width"))
    run, group = Window.partitionBy("run_id"), Window.partitionBy("run_id", "wanted")
    s = s.withColumns({"left": F.greatest(F.lit(total) - F.sum("base").over(run), F.lit(0)), "before_us": F.sum(F.when(F.col("wanted"), F.col("room")).otherwise(0)).over(run)})
    s = s.withColumn("left", F.when(F.col("wanted"), F.col("left")).otherwise(F.greatest(F.col("left") - F.col("before_us"), F.lit(0))))
    rising = group.orderBy(F.col("room") / F.col("width"), "source_id")
    lower = F.coalesce(F.sum("room").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = F.sum("width").over(rising.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("left") - lower) / width)
    share = F.least(F.col("room"), F.floor(F.max("level").over(group) * F.col("width") + F.lit(1e-6)))
    return s.select("run_id", "source_id", (F.col("base") + F.greatest(share, F.lit(0))).cast("long").alias("budget"))


def needs_claims(runs: DataFrame, followup_cost: float = 0.05, reserve: float = 0.04, most_cost: float = 0.40) -> DataFrame:
    """run_id of runs(run_id, claims_verified, cost) with too few verified claims and money left to ask for more."""
    spent = F.coalesce("cost", F.lit(0.0)) + F.lit(followup_cost) + F.lit(reserve)
    return runs.where((F.coalesce("claims_verified", F.lit(0)) < CLAIMS_ENOUGH) & (spent < most_cost)).select("run_id")


def claim_passages(chunks: DataFrame, sources: DataFrame, runs: DataFrame, budget: int = CLAIMS_CHARS) -> DataFrame:
    """run_id, source_id, chosen, windows: the most qualitative chunks of these runs' sources, filings left out.

    chunks(source_id, i, start, end, qual), sources(run_id, source_id, filing), runs(run_id). Chunks are taken in the
    order of their score while they fit; what doesn't fit is skipped. Of chunks of one size a later one is only taken
    after all earlier ones, so those beyond budget / size of a size can't be; what is left of a run is bounded by the
    budget alone, however many sources it has, and is found in salted groups.
    """
    s = sources.where(~F.col("filing")).join(runs.select("run_id").distinct(), "run_id", "left_semi").select("run_id", "source_id")
    c = chunks.where("qual > 0").join(s, "source_id").select("run_id", "source_id", "i", "start", "end", "qual", (F.col("end") - F.col("start")).alias("size"))
    c = c.where(F.col("size") <= budget).withColumn("salt", F.pmod(F.xxhash64("source_id", "i"), F.lit(_SALTS)))
    for keys in (("run_id", "size", "salt"), ("run_id", "size")):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("qual"), F.col("source_id").cast("string"), "i"))
        c = c.withColumn("place", place).where(F.col("place") <= F.floor(F.lit(budget) / F.col("size"))).drop("place")
    order = F.struct((-F.col("qual").cast("double")).alias("order"), F.col("source_id").cast("string").alias("name"), "i", "source_id", "start", "end", "size")
    fits = lambda a, x: a["used"] + x["size"] <= budget
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["taken"], F.array(x)).alias("taken"))).otherwise(a)
    listed = c.groupBy("run_id").agg(F.array_sort(F.collect_list(order)).alias("c"))
    nothing = F.struct(F.lit(0).alias("used"), F.filter("c", lambda x: F.lit(False)).alias("taken"))
    taken = listed.select("run_id", F.explode(F.aggregate("c", nothing, step)["taken"]).alias("t"))
    per = taken.groupBy("run_id", "t.source_id").agg(F.array_sort(F.collect_list(F.struct("t.i", "t.start", "t.end"))).alias("t"))
    at = lambda i: F.filter("t", lambda x: x["i"] == i)[0]
    numbers = F.transform("t", lambda x: x["i"])
    per = per.select("run_id", "source_id", "t", numbers.alias("chosen"))
    edge = lambda d: F.filter("chosen", lambda i: ~F.array_contains("chosen", i + d))
    pairs = F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b"))
    return per.select("run_id", "source_id", "chosen", F.transform(pairs, lambda p: F.struct(at(p["a"])["start"].alias("start"), at(p["b"])["end"].alias("end"))).alias("windows"))
