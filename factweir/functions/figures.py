"""What the quote of a figure says: footnotes, runs of values, scales, and the rules that move or reject it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweir.functions import patterns as p

SCORED_ENERGY = ("energy_consumption", "electricity_consumption", "energy_generated")
ENERGY_KEYS = (*SCORED_ENERGY, "energy_sold", "energy_storage_deployed", "energy_supplied")
#: The largest and smallest plausible figures by metric, in joules, watts and dollars.
ENERGY_MOST = 3e12 * 3.15576e7
MOST = dict.fromkeys(ENERGY_KEYS, ENERGY_MOST) | {"datacenter_capacity_operating": 5e10, "datacenter_capacity_planned": 2e11, "capex": 1e12, "revenue": 3e12}
LEAST = {"capex": 1e5, "revenue": 1e5}
#: How any amount of `amount_pattern` ends.
CAPACITY = r"[0-9]\s*(?:MW|GW|megawatts?|gigawatts?)\b"
#: White space after the end of a sentence; what is rarer is sought first.
SENTENCE_END = r"\s(?<=[.!?]\s)\s*"
SCALES = {"thousands": 1e3, "millions": 1e6, "billions": 1e9}


def says(text: Column, pattern: str) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit("(?i)" + pattern))


def same_sentence(quote: Column, context: Column) -> Column:
    """The part of the context in the quote's sentence or row; all of it if the quote isn't there.

    Sentences end at a period, question or exclamation mark before a blank; to the right, at the first two.
    """
    at = F.instr(context, quote)
    before = F.regexp_replace(F.substring(context, F.lit(1), at - 1), r"(?s)^.*[.?!] ", "")
    rest = F.substring(context, at + F.length(quote), F.length(context))
    after = F.coalesce(F.nullif(F.regexp_extract(rest, r"(?s)^(.*?[.?]) ", 1), F.lit("")), rest)
    return F.when((quote == "") | (at == 0), context).otherwise(F.concat(before, quote, after))


def footnotes_used(quote: Column) -> Column:
    """Footnote signs right after a word or number."""
    return F.array_distinct(F.regexp_extract_all(quote, F.lit(p.FOOTNOTE_USED), F.lit(1)))


def footnote_texts(quote: Column, around: Column) -> Column:
    """What the footnotes used in the quote say in the text around it: a sign of its own, then its words.

    Several footnotes may share a sign; all are given.
    """
    notes = F.regexp_extract_all(around, F.lit(rf"(?:^|\s)((?:\*{{1,3}}|[{p.FOOTNOTE_SIGNS[1:]}])(?![{p.FOOTNOTE_SIGNS}])\s*[A-Za-z(][^{p.FOOTNOTE_SIGNS}]{{3,160}})"), F.lit(1))
    sign = lambda note: F.regexp_extract(note, rf"^([{p.FOOTNOTE_SIGNS}]+)", 1)
    used = F.filter(notes, lambda note: F.array_contains(footnotes_used(quote), sign(note)))
    return F.transform(used, lambda note: F.trim(F.regexp_replace(note, rf"^[{p.FOOTNOTE_SIGNS}]+\s*", "")))


def unlabelled_values(quote: Column, row: Column) -> Column:
    """The values of a run of two or more under one unit heading, not one for each year; empty if there is none.

    A run of the row counts only if it holds a number of the quote.
    """

    def runs(text: Column) -> Column:
        words = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p.UNLABELLED_RUN), F.lit(1)), lambda r: F.split(F.trim(F.regexp_replace(r, r"(?i)FY\s+", "FY")), r"\s+"))
        year = lambda w: F.regexp_like(w, F.lit("(?i)^(FY)?(19|20)[0-9]{2}$"))
        split = F.transform(words, lambda ws: F.struct(F.filter(ws, year).alias("years"), F.filter(ws, lambda w: ~year(w)).alias("values")))
        kept = F.filter(split, lambda s: (F.size(s["values"]) >= 2) & (F.size(s["years"]) < F.size(s["values"])))
        return F.transform(kept, lambda s: s["values"])

    numbers = F.regexp_extract_all(quote, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    own, other = runs(quote), F.filter(runs(row), lambda vs: F.arrays_overlap(vs, numbers))
    return F.coalesce(F.get(F.concat(own, other), F.lit(0)), F.array().cast("array<string>"))


def table_scale(text: Column, at: Column, before: int = 8000, after: int = 200) -> Column:
    """The factor of the last phrase such as `(in millions)` before a place; null if there is none."""
    start = F.greatest(at - before, F.lit(1))
    return scale_in(F.substring(text, start, at + after - start))


def scale_in(text: Column) -> Column:
    """The factor of the last phrase such as `(in millions)` of a text; null if there is none."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + p.TABLE_SCALE), F.lit(1))
    factor = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return factor[F.lower(F.try_element_at(found, F.lit(-1)))]


def has_inline_scale(quote: Column) -> Column:
    return says(quote, p.INLINE_SCALE)


def metric_category(metric: Column) -> Column:
    return F.when(metric.startswith("energy") | metric.startswith("electricity"), "energy_throughput").when(metric.startswith("datacenter"), "compute_capacity").otherwise("growth")


def implausible(metric: Column, si: Column) -> Column:
    """Above the most or below the least that the metric allows; null where it is plausible."""
    bound = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[metric]
    return F.when(si > bound(MOST), "implausibly large").when(si < bound(LEAST), "implausibly small")


def check_figure(metric: Column, quote: Column, year: Column, is_primary: Column, current_year: int, row: Column | None = None, footnotes: Column | None = None) -> Column:
    """struct(ok, metric_key, reason): the first rule that fits moves the figure to another metric or rejects it.

    row: text around the quote; footnotes: what its footnotes say.
    """
    row = F.lit("") if row is None else F.coalesce(row, F.lit(""))
    notes = F.array().cast("array<string>") if footnotes is None else F.coalesce(footnotes, F.array().cast("array<string>"))
    quote = F.coalesce(quote, F.lit(""))
    q = {k: says(quote, getattr(p, k)) for k in ("STORAGE", "SOLD", "CONSUME", "GENERATE", "CAPEX", "FINANCING", "DEAL", "FORWARD", "RUN_RATE", "FUTURE_CAPACITY", "OPERATING", "TOTAL")}
    late = F.coalesce(year > current_year, F.lit(False))
    supplied = (metric == "energy_supplied") & q["GENERATE"] & ~q["SOLD"]
    key = F.when(supplied, "energy_generated").otherwise(metric)
    energy, scored = metric.isin(*ENERGY_KEYS), key.isin(*SCORED_ENERGY)
    consumed, capacity, capex, revenue = metric.isin("energy_consumption", "electricity_consumption"), metric == "datacenter_capacity_operating", metric == "capex", metric == "revenue"
    planned = "datacenter_capacity_planned"
    rules = (
        (energy & (metric != "energy_storage_deployed") & q["STORAGE"], "energy_storage_deployed", "moved"),
        ((metric == "energy_supplied") & ~supplied, "energy_sold", "moved"),
        (consumed & q["SOLD"] & ~q["CONSUME"], "energy_sold", "moved"),
        (consumed & q["GENERATE"] & ~q["CONSUME"], "energy_generated", "moved"),
        ((key == "energy_generated") & q["SOLD"] & ~q["GENERATE"], "energy_sold", "moved"),
        (scored & late, None, "future period"),
        (scored & ~q["TOTAL"] & (F.size(unlabelled_values(quote, row)) > 0), None, "ambiguous"),
        (capacity & (q["FUTURE_CAPACITY"] | late), planned, "moved"),
        (capacity & ~q["OPERATING"] & says(same_sentence(quote, row), p.FUTURE_CAPACITY), planned, "moved"),
        (capacity & F.exists(notes, lambda n: says(n, p.FUTURE_CAPACITY)), planned, "moved"),
        (capacity & ~q["OPERATING"] & (F.size(footnotes_used(quote)) > 0) & (F.size(notes) == 0), planned, "moved"),
        (capex & q["FINANCING"], None, "financing"),
        (capex & q["DEAL"] & ~q["CAPEX"], None, "deal"),
        (capex & ~says(F.concat_ws(" ", quote, row), p.CAPEX), None, "not a capital expenditure"),
        (capex & q["FORWARD"], None, "forecast"),
        (capex & ~is_primary, None, "not a primary source"),
        (revenue & q["RUN_RATE"], None, "run rate"),
        (revenue & q["FORWARD"], None, "forecast"),
        ((capex | revenue) & year.isNull(), None, "no period"),
        ((capex | revenue) & late, None, "future period"),
    )
    out = F.struct(F.lit(True).alias("ok"), key.alias("metric_key"), F.lit("").alias("reason"))
    for fits, moved, reason in reversed(rules):
        verdict = F.struct(F.lit(moved is not None).alias("ok"), (key if moved is None else F.lit(moved)).alias("metric_key"), F.lit(reason).alias("reason"))
        out = F.when(fits, verdict).otherwise(out)
    return out


def amount_pattern(megawatts: Column) -> Column:
    """An expression for a capacity as prose writes it: 3 GW, 3GW, 3 gigawatts, 3,000 MW; case doesn't count."""

    def number(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.format_number(x, 2), r"0+$", ""), r"\.$", "")
        return F.replace(F.replace(plain, F.lit("."), F.lit(r"\.")), F.lit(","), F.lit(",?"))

    small = F.concat(F.lit(r"(?<![0-9.])"), number(megawatts), F.lit(r"\s*(?:MW|megawatts?)\b"))
    large = F.concat(F.lit(r"(?<![0-9.])"), number(megawatts / 1000), F.lit(r"\s*(?:GW|gigawatts?)\b"))
    return F.when(megawatts >= 100, F.concat(large, F.lit("|"), small)).otherwise(small)


def without_future(text: Column, megawatts: Column) -> Column:
    """The text less sentences that speak of one of these future capacities as operating; null if none is left.

    A sentence stays if words such as `planned` stand right beside each mention.
    """
    sentences = F.split(F.trim(text), SENTENCE_END)
    amounts = F.transform(F.filter(megawatts, lambda m: m > 0), amount_pattern)

    def claims(sentence: Column) -> Column:
        bare = lambda a: F.regexp_like(sentence, F.concat(F.lit("(?is)"), a))
        marked = lambda a: F.regexp_like(sentence, F.concat(F.lit(rf"(?is){p.PLANNED_NEAR}.{{0,20}}(?:"), a, F.lit(rf")|(?:"), a, F.lit(rf").{{0,25}}{p.PLANNED_NEAR}")))
        # most sentences name no capacity: one fixed expression spares them those of each amount, which are compiled anew
        return says(sentence, CAPACITY) & says(sentence, p.OPERATING) & F.exists(amounts, lambda a: bare(a) & ~marked(a))

    left = F.trim(F.array_join(F.filter(sentences, lambda s: ~claims(s)), " "))
    return F.when(F.size(amounts) == 0, text).otherwise(F.nullif(left, F.lit("")))
