"""Where a quote stands in its source, and whether a figure's quote supports it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweir.functions import figures, kernels, letters, text
from factweir.operators import evidence
from factweir.shipping import ship_for_texts

#: Quotes of one source that are sought together; a source with more of them is sent to as many tasks.
TOGETHER = 1000
#: Characters of the source on either side of a span that later checks read, by name.
CUTS = {"row": 200, "near": 300, "around": 2500}
#: Characters before and after the start of a quote where a table may state its scale.
SCALE_BEFORE, SCALE_AFTER = 8000, 200
#: How a unit is written near its number.
UNIT_WORDS = {
    "MWh": ("mwh", "megawatt hour", "megawatt-hour", "megawatthour"), "GWh": ("gwh", "gigawatt hour", "gigawatt-hour", "gigawatthour"),
    "TWh": ("twh", "terawatt hour", "terawatt-hour", "terawatthour"), "kWh": ("kwh", "kilowatt hour", "kilowatt-hour", "kilowatthour"),
    "PWh": ("pwh",), "Wh": ("wh",), "GJ": ("gj", "gigajoule"), "TJ": ("tj", "terajoule"), "PJ": ("pj", "petajoule"), "MJ": ("mj", "megajoule"),
    "EJ": ("ej", "exajoule"), "kJ": ("kj",), "J": ("joule",), "MMBtu": ("mmbtu", "million btu"),
    "MW": ("mw", "megawatt"), "GW": ("gw", "gigawatt"), "kW": ("kw", "kilowatt"), "TW": ("tw", "terawatt"), "W": ("watt",),
    "USD": ("$", "usd", "dollar"), "USD_thousands": ("$", "usd", "thousand", "dollar"), "USD_millions": ("$", "usd", "million", "dollar"), "USD_billions": ("$", "usd", "billion", "dollar"),
}


def locate_quotes(rows: DataFrame, sources: DataFrame, contexts: bool = False, together: int = TOGETHER) -> DataFrame:
    """rows(source_id, quote, ...) with method, start (from 1), end and span: where the quote stands in
    sources(source_id, text); null if it doesn't, is too short or long, or its source isn't there or is null.

    exact: in normal form; loose: letter by letter; footnote: without the digits of footnote marks; ellipsis: its
    pieces in order. With `contexts` also what stands around the span (see CUTS) and before it, and the span's numbers. The index of a
    source is built once for up to about `together` quotes; a source with more is split by a hash of the rows, so
    none gathers in one task. Equal rows stay rows of their own; source_id is unique in `sources`.
    """
    ship_for_texts(rows.sparkSession)
    names = rows.columns
    every = F.struct(*[F.col(f"`{c}`") for c in names])
    counts = rows.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / together).alias("_blocks"))
    block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.col("_blocks"))
    dealt = rows.join(counts, "source_id").groupBy("source_id", block.alias("_block")).agg(F.collect_list(every).alias("rows"))
    found = dealt.join(sources.select("source_id", "text"), "source_id", "left").select("rows", "text")
    asked = found.unionByName(rows.where("source_id IS NULL").select(F.array(every).alias("rows"), F.lit(None).cast("string").alias("text")))
    quote_at, extra = names.index("quote"), [*CUTS, "before"] if contexts else []

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.string()] * len(extra), *[pa.list_(pa.float64())] * contexts]
    names_out = [*names, "method", "start", "end", "span", *extra, *["numbers"] * contexts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten()
            quotes = iter(flat.field(quote_at).to_pylist())
            out: list[tuple] = []
            for n, body in zip(b.column(0).value_lengths().to_pylist(), b.column(1).to_pylist(), strict=True):
                source = None if body is None else letters.Source(body)
                for quote in (next(quotes) for _ in range(n)):
                    at = source.find(quote) if source and quote else None
                    if not at:
                        out.append((None,) * len(kinds))
                        continue
                    method, start, end = at[0], int(at[1]), int(at[2])
                    cuts = [body[max(0, start - k) : end + k] for k in CUTS.values()] + [body[max(0, start - SCALE_BEFORE) : start + SCALE_AFTER], kernels.numbers(body[start:end])] if contexts else []
                    out.append((method, start + 1, end, body[start:end], *cuts))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[flat.field(i) for i in range(len(names))], *columns], names=names_out)

    made = T.StructType().add("method", "string").add("start", "integer").add("end", "integer").add("span", "string")
    more = [*[T.StructField(n, T.StringType()) for n in extra], *[T.StructField("numbers", T.ArrayType(T.DoubleType()))] * contexts]
    return asked.mapInArrow(run, T.StructType([*rows.schema.fields, *made.fields, *more]))


def quote_places(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quote_id, source_id, method, start (from 1), end, span of every source of sources(source_id, text) that
    holds a quote of quotes(quote_id, quote) letter by letter; texts are those that share the quote's anchor."""
    pairs = evidence.candidate_sources(quotes, sources).join(quotes.select("quote_id", "quote"), "quote_id")
    return locate_quotes(pairs.select("quote_id", "source_id", "quote"), sources).where("method IS NOT NULL").drop("quote")


@F.pandas_udf(T.StructType([T.StructField("letters", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
def letter_index(text: pd.Series) -> pd.DataFrame:
    """The index of a text: its letters and digits, and the place (from 1) of the character behind each."""
    got = [letters.indexed(x or "") for x in text]
    return pd.DataFrame({"letters": [a for a, _ in got], "places": [p + 1 for _, p in got]})


def unit_present(unit: Column, around: Column) -> Column:
    """A spelling of the unit, or the words as given, starts a word of the text."""
    table = F.create_map(*[x for k, words in UNIT_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in words]))])
    words = F.coalesce(table[unit], F.array(F.lower(unit)))
    # the word is sought as it stands first, as an expression for each is compiled anew
    return F.exists(words, lambda w: F.contains(F.lower(around), w) & F.regexp_like(F.lower(around), F.concat(F.lit(r"(?:^|[^a-z])\Q"), w, F.lit(r"\E"))))


def verify_figures(rows: DataFrame, sources: DataFrame, current_year: int) -> DataFrame:
    """Per figure: figure_id, method, metric_key (after the rules), si and `reason`, the first check that fails.

    rows(figure_id, source_id, metric_key, value, unit, factor, family, period_year, is_primary, quote), factor and
    family being null for an unknown unit; sources(source_id, text). Order: quote found; unit known; value in the quote
    (times a table's scale for dollars); unit near; plausible; then the rules of `check_figure`. Texts stay with the
    search for quotes; later checks read what it cut out around each.
    """
    r = locate_quotes(rows, sources, contexts=True)
    r = r.withColumns({"numbers": F.coalesce("numbers", F.array().cast("array<double>")), "scale": figures.scale_in(F.col("before"))})
    money = F.col("metric_key").isin("capex", "revenue") & (F.col("unit") == "USD") & ~figures.has_inline_scale(F.col("quote"))
    direct = text.number_matches(F.col("numbers"), F.col("value"))
    scaled = money & F.col("scale").isNotNull() & text.number_matches(F.transform("numbers", lambda n: n * F.col("scale")), F.col("value"))
    # a number read off a table in thousands or millions is worth that much
    r = r.withColumns({"direct": F.coalesce(direct, F.lit(False)), "scaled": F.coalesce(scaled, F.lit(False))})
    r = r.withColumn("si", F.col("value") * F.col("factor") * F.when(money & F.col("direct") & F.col("scale").isNotNull(), F.col("scale")).otherwise(1.0))
    verdict = figures.check_figure(F.col("metric_key"), F.col("quote"), F.col("period_year"), F.col("is_primary"), current_year, F.col("row"), figures.footnote_texts(F.col("quote"), F.col("around")))
    r = r.select("*", F.explode(F.array(verdict)).alias("verdict"))
    reason = (
        F.when(F.col("method").isNull(), "quote not found")
        .when(F.col("factor").isNull(), "unit not supported")
        .when(~F.col("direct") & ~F.col("scaled"), "value not in the quote")
        .when(~(money & F.col("scale").isNotNull()) & ~unit_present(F.col("unit"), F.col("near")), "unit not near")
        .otherwise(F.coalesce(figures.implausible(F.col("metric_key"), F.col("si")), F.when(~F.col("verdict.ok"), F.col("verdict.reason"))))
    )
    return r.select("figure_id", "method", F.when(reason.isNull(), F.col("verdict.metric_key")).otherwise(F.col("metric_key")).alias("metric_key"), "si", reason.alias("reason"))
