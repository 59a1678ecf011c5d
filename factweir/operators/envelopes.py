"""Strict reading of model answers: the JSON in a text, and which of its items are fit for use, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of metrics, known metrics, judged categories.
METRIC_ALIASES = {
    "energy_consumed": "energy_consumption", "electricity_consumed": "electricity_consumption", "energy_storage": "energy_storage_deployed",
    "storage_deployed": "energy_storage_deployed", "energy_delivered": "energy_sold",
}
METRICS = (
    "energy_consumption", "electricity_consumption", "energy_generated", "energy_sold", "energy_storage_deployed", "energy_supplied",
    "datacenter_capacity_operating", "datacenter_capacity_planned", "capex", "revenue",
)
JUDGED = ("frontier_acceleration", "builder_velocity", "policy_stance")
#: Most items of an answer that are read.
MAX_FIGURES, MAX_CLAIMS, MAX_SOURCES = 40, 30, 15


def json_text(answer: Column) -> Column:
    """The JSON object of an answer, without code fences and talk around it; null if there is none."""
    plain = F.trim(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"^```[A-Za-z]*\s*|\s*```$", ""))
    cut = F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda c: F.try_parse_json(c).isNotNull() & F.startswith(c, F.lit("{"))
    return F.when(valid(plain), plain).when(valid(cut), cut)


def evidence_id(value: Column) -> Column:
    """A number from `5`, `E5` or `[E5]`; null for anything else."""
    return F.nullif(F.regexp_extract(value, r"(?i)^\s*\[?E?([0-9]{1,18})\]?\s*$", 1), F.lit("")).cast("long")


def _text(value: Column, most: int) -> Column:
    """Trimmed, cut to its most characters; null if blank."""
    return F.nullif(F.left(F.trim(value), F.lit(most)), F.lit(""))


def _items(answers: DataFrame, field: str, schema: str, most: int) -> DataFrame:
    """answer_id, pos and the item's fields as strings: the first `most` items of an array of the answer."""
    raw = answers.select("answer_id", F.from_json(F.get_json_object("json", f"$.{field}"), "array<string>").alias("items"))
    item = raw.select("answer_id", F.posexplode(F.slice("items", 1, most)).alias("pos", "raw"))
    return item.select("answer_id", "pos", "raw", F.from_json("raw", schema).alias("f")).select("answer_id", "pos", F.startswith("raw", F.lit("{")).alias("is_object"), "f.*")


def _first(*cases: tuple[Column, str | Column]) -> Column:
    """The reason of the first case that fits; null if none does."""
    out = F.lit(None).cast("string")
    for fits, reason in reversed(cases):
        out = F.when(fits, F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def parsed(answers: DataFrame) -> DataFrame:
    """answers(answer_id, answer) with `json`, and `fatal`: why the whole answer can't be used."""
    j = answers.select("answer_id", json_text(F.col("answer")).alias("json"))
    is_list = lambda f: F.coalesce(F.startswith(F.get_json_object("json", f"$.{f}"), F.lit("[")), F.lit(True))
    return j.withColumn("fatal", _first((F.col("json").isNull(), "no object"), (~is_list("figures") | ~is_list("claims"), "not a list")))


def figures(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Figures of parsed answers: answer_id, pos, fields, and `reason` for the dropped ones (null if fit).

    sources(answer_id, source_id) are those that an answer may name. Spending may be printed as negative.
    """
    schema = "struct<source_id:string,metric_key:string,value:string,unit:string,period:string,scope:string,quote:string>"
    f = _items(answers.where("fatal IS NULL"), "figures", schema, MAX_FIGURES)
    alias = F.create_map(*[F.lit(x) for kv in METRIC_ALIASES.items() for x in kv])
    key = _text(F.col("metric_key"), 48)
    f = f.select("answer_id", "pos", "is_object", _text(F.col("source_id"), 10).alias("source_id"), F.coalesce(alias[key], key).alias("metric_key"), F.expr("try_cast(value AS double)").alias("value"), _text(F.col("unit"), 24).alias("unit"), _text(F.col("period"), 16).alias("period"), _text(F.col("scope"), 200).alias("scope"), _text(F.col("quote"), 800).alias("quote"))
    f = f.join(sources.select("answer_id", "source_id", F.lit(True).alias("known")).distinct(), ["answer_id", "source_id"], "left")
    number = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    reason = _first(
        (~F.col("is_object"), "not an object"), (F.col("source_id").isNull(), "source_id is required"), (F.col("known").isNull(), "unknown source_id"),
        (F.col("metric_key").isNull(), "metric_key is required"), (~F.col("metric_key").isin(*METRICS), "unknown metric_key"), (~number, "value must be a finite number"),
        ((F.col("value") < 0) & (F.col("metric_key") != "capex"), "value out of range"), (F.col("unit").isNull(), "unit is required"), (F.col("quote").isNull(), "quote is required"),
    )
    return f.select("answer_id", "pos", "source_id", "metric_key", F.when(F.col("metric_key") == "capex", F.abs("value")).otherwise(F.col("value")).alias("value"), "unit", "period", "scope", "quote", reason.alias("reason"))


def claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims of parsed answers, as `figures`."""
    c = _items(answers.where("fatal IS NULL"), "claims", "struct<source_id:string,category:string,claim:string,quote:string>", MAX_CLAIMS)
    c = c.select("answer_id", "pos", "is_object", _text(F.col("source_id"), 10).alias("source_id"), _text(F.col("category"), 32).alias("category"), _text(F.col("claim"), 300).alias("claim"), _text(F.col("quote"), 800).alias("quote"))
    c = c.join(sources.select("answer_id", "source_id", F.lit(True).alias("known")).distinct(), ["answer_id", "source_id"], "left")
    reason = _first(
        (~F.col("is_object"), "not an object"), (F.col("source_id").isNull(), "source_id is required"), (F.col("known").isNull(), "unknown source_id"), (F.col("category").isNull(), "category is required"),
        (~F.col("category").isin(*JUDGED), "unknown category"), (F.col("claim").isNull(), "claim is required"), (F.col("quote").isNull(), "quote is required"),
    )
    return c.select("answer_id", "pos", "source_id", "category", "claim", "quote", reason.alias("reason"))


def judgements(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each answer and judged category: score, confidence, insufficient, evidence_ids, n_dropped.

    answers(answer_id, json), evidence(answer_id, evidence_id). The first entry of a category counts; ids are kept in
    order if they are the answer's evidence. Without a score from 0 to 10 and an id left, it is insufficient.
    """
    items = _items(answers, "categories", "struct<category:string,score:string,confidence:string,insufficient_evidence:boolean,evidence_ids:string,rationale:string>", 1000)
    first = items.where(F.col("category").isin(*JUDGED)).groupBy("answer_id", "category").agg(F.min_by(F.struct("score", "confidence", "insufficient_evidence", "evidence_ids"), "pos").alias("e"))
    ids = F.coalesce(F.from_json("e.evidence_ids", "array<string>"), F.array("e.evidence_ids"))
    given = first.select("answer_id", "category", "e", F.array_distinct(F.transform(F.array_compact(ids), evidence_id)).alias("ids"), F.size(F.array_compact(ids)).alias("n_ids"))
    held = evidence.groupBy("answer_id").agg(F.collect_set("evidence_id").alias("held"))  # the evidence shown with one question
    joined = given.join(held, "answer_id", "left")
    kept = F.filter("ids", lambda i: F.coalesce(F.array_contains("held", i), F.lit(False)))
    score, sure = F.expr("try_cast(e.score AS double)"), F.expr("try_cast(e.confidence AS double)")
    ok = score.between(0, 10) & ~F.coalesce(F.col("e.insufficient_evidence"), F.lit(False)) & (F.size(kept) > 0)
    judged = joined.select("answer_id", "category", F.coalesce(ok, F.lit(False)).alias("ok"), F.round(score, 1).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.0)))).alias("c"), kept.alias("kept"), (F.col("n_ids") - F.size(kept)).alias("n_dropped"))
    every = answers.select("answer_id").distinct().select("answer_id", F.explode(F.array(*[F.lit(c) for c in JUDGED])).alias("category"))
    out = every.join(judged, ["answer_id", "category"], "left")
    good = F.coalesce("ok", F.lit(False))
    return out.select("answer_id", "category", F.when(good, F.col("s")).alias("score"), F.when(good, F.col("c")).otherwise(0.0).alias("confidence"), (~good).alias("insufficient"), F.coalesce("kept", F.array().cast("array<bigint>")).alias("evidence_ids"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))


def research(answers: DataFrame) -> DataFrame:
    """Sources that a research answer names: answer_id, pos, url, title, covers, why; http and https links only."""
    s = _items(answers.where("json IS NOT NULL"), "sources", "struct<url:string,title:string,covers:array<string>,why:string>", MAX_SOURCES)
    s = s.where(F.startswith("url", F.lit("http://")) | F.startswith("url", F.lit("https://")))
    return s.select("answer_id", "pos", F.trim("url").alias("url"), _text(F.col("title"), 200).alias("title"), F.coalesce("covers", F.array().cast("array<string>")).alias("covers"), _text(F.col("why"), 200).alias("why"))


def resolved(answers: DataFrame) -> DataFrame:
    """The entity of a resolving answer: answer_id, official_name, domain, ticker, exchange, is_public, confidence, fatal."""
    r = answers.select("answer_id", "json", F.from_json("json", "struct<official_name:string,domain:string,ticker:string,exchange:string,is_public:string,confidence:string>").alias("r"))
    domain = F.regexp_replace(F.regexp_replace(F.lower(_text(F.col("r.domain"), 120)), r"^https?://", ""), r"^www\.|/.*$", "")
    sure = F.when(F.col("r.confidence").isNull(), F.lit(0.5)).otherwise(F.expr("try_cast(r.confidence AS double)"))
    fatal = _first((F.col("json").isNull(), "no object"), (_text(F.col("r.official_name"), 200).isNull(), "official_name is required"), (F.coalesce(~sure.between(0, 1), F.lit(True)), "confidence out of range"))
    return r.select("answer_id", _text(F.col("r.official_name"), 200).alias("official_name"), F.nullif(domain, F.lit("")).alias("domain"), F.upper(_text(F.col("r.ticker"), 16)).alias("ticker"), _text(F.col("r.exchange"), 32).alias("exchange"), F.expr("try_cast(r.is_public AS boolean)").alias("is_public"), sure.alias("confidence"), fatal.alias("fatal"))
