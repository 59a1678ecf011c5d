"""Mixing to target weights with soft membership.

A classifier learned from the labels table gives each document posteriors over domains. Projected gradient
descent then fits nonnegative document rates whose expected domain token totals match the targets in the
least-squares sense. Rates depend on posteriors alone, so documents are summed up by their feature bins
first, and each gradient step is one small aggregation over those groups; a document's rate is the fold of
the steps' residuals over its posteriors. Everything is DataFrame expressions; no Python runs on executors.

Domains: `toxic` (label toxic), else `low` (quality 0), else `clean`.

Defined results: null texts are empty and have features like any text; rows are independent, so repeated
rows and null ids get a row each; with several labels of a document the worst counts; without labels every
posterior is the same and every rate 1; a domain without tokens can't be matched and is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweir.llm.common import pick, work_dir, written
from factweir.llm.quality_rules import words_of

DOMAINS = ("clean", "low", "toxic")
#: Upper bounds of the bins of each feature: shares of words, but for hits (words of the lexicon).
BINS = {
    "marked": (0.0, 0.02, 0.1, 0.3, 0.6),
    "bars": (0.0, 0.02, 0.1, 0.3),
    "capitals": (0.017, 0.08, 0.25, 0.5),
    "repeated": (0.3, 0.5, 0.7, 0.85, 0.95),
    "hits": (0.0, 1.0, 2.0, 4.0),
}
LEXICON_WORDS = 200


@dataclass(frozen=True)
class Model:
    """Bounded by bins, domains and LEXICON_WORDS: words that tell toxic texts, and log-probabilities."""

    lexicon: tuple[str, ...]
    prior: tuple[float, ...]
    bins: dict[str, list[list[float]]]  # feature, bin, domain


#: Punctuation that words lose at their ends.
PUNCTUATION = ".,;:!?()[]{}<>\"'`*#$%&|/\\-_+=~^@«»“”„‘’…·•–—¿¡"


def _plain(text: Column) -> Column:
    """The distinct words of a text in lower case without punctuation at their ends."""
    return F.array_distinct(F.transform(F.array_distinct(words_of(F.lower(text))), lambda w: F.btrim(w, F.lit(PUNCTUATION))))


def features(docs: DataFrame, lexicon: tuple[str, ...]) -> DataFrame:
    """docs(doc_id, text, ...) with n_words and the bin of each feature, without the text."""
    others = [c for c in docs.columns if c != "text"]
    base = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", words_of(F.col("_t")))
    base = base.withColumn("n_words", F.size("_w").cast("long")).withColumn("_d", _plain(F.col("_t")))
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = {
        "marked": F.regexp_count("_t", F.lit(r"(?:[#*$%&]{2,}|!{2,})[.,]?(?!\S)")) / n,
        "bars": F.regexp_count("_t", F.lit(r"[|>](?<!\S.)(?!\S)")) / n,
        "capitals": F.regexp_count("_t", F.lit(r"\p{Lu}")) / F.greatest(F.length("_t"), F.lit(1)),
        "repeated": 1 - F.size("_d") / n - F.least(F.lit(0.25), F.lit(0.05) * F.log10(n)),
        "hits": F.size(F.array_intersect("_d", F.array(*[F.lit(w) for w in lexicon]).cast("array<string>"))).cast("double"),
    }
    step = base.select(*others, "n_words", *[c.cast("double").alias(f"_{k}") for k, c in raw.items()])
    bin_of = lambda k: sum([(F.col(f"_{k}") > F.lit(b)).cast("int") for b in BINS[k]], F.lit(0))
    return step.select(*others, "n_words", *[bin_of(k).alias(k) for k in BINS])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    """Naive Bayes over feature bins, from about sample_rows random labelled rows (all, if fewer).

    The lexicon holds the words that tell toxic texts best, whose log odds stay over 1 after 2.5 standard errors.
    """
    marks = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") < 1, 1).otherwise(0)
    marks = marks.select("doc_id", domain.alias("domain"))
    n = marks.count()
    share = min(1.0, sample_rows / max(n, 1))
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    some = pick(docs, "doc_id", "text").join(F.broadcast(marks) if sample_rows <= 1_000_000 else marks, "doc_id").select("text", "domain")
    some = written(some, work_dir(docs.sparkSession, "mixing-sample"))
    sizes = {r["domain"]: r["n"] for r in some.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(2, 0), sizes.get(0, 0) + sizes.get(1, 0)
    words = some.select("domain", F.explode(_plain(F.coalesce("text", F.lit("")))).alias("word")).where("word <> ''")
    seen = words.groupBy("word").agg(F.count(F.when(F.col("domain") == 2, 1)).alias("bad"), F.count(F.when(F.col("domain") != 2, 1)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = seen.where("bad >= 3").select("word", (odds - 2.5 * error).alias("sure"), "bad").where("sure > 1").orderBy(F.desc(F.col("sure") * F.log1p("bad")), "word").limit(LEXICON_WORDS)
    lexicon = tuple(r["word"] for r in best.collect())
    k = len(DOMAINS)
    total = sum(sizes.values())
    prior = tuple(math.log((sizes.get(d, 0) + 1) / (total + k)) for d in range(k))
    found = features(some, lexicon)
    pairs = found.select("domain", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in BINS])).alias("x"))
    counts = {(r["feature"], r["bin"], r["domain"]): r["n"] for r in pairs.groupBy("x.feature", "x.bin", "domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = {f: [[math.log((counts.get((f, b, d), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * (len(cuts) + 1))) for d in range(k)] for b in range(len(cuts) + 1)] for f, cuts in BINS.items()}
    return Model(lexicon, prior, table)


def posteriors(found: DataFrame, model: Model) -> DataFrame:
    """`found` (of `features`) with `p`: the posterior of each domain, in DOMAINS' order."""
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    score = [F.lit(float(model.prior[d])) for d in range(len(DOMAINS))]
    for f, rows in model.bins.items():
        score = [s + F.get(lit([r[d] for r in rows]), F.col(f)) for d, s in enumerate(score)]
    step = found.withColumn("_s", F.array(*score)).withColumn("_top", F.array_max("_s"))
    step = step.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.col("_top")))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return step.withColumn("p", F.transform("_e", lambda x: x / F.col("_z"))).drop("_s", "_top", "_e", "_z")


def fold_rate(p: Column, steps: Column, ridge: float, max_rate: float) -> Column:
    """A document's rate after projected gradient steps from 1, and the point that the next step starts from.

    steps: for each step the residuals of the domains and, last, the momentum that follows it.
    """

    def step(s: Column, r: Column) -> Column:
        pull = F.aggregate(F.zip_with(p, r, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        moved = F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), s["next"] - (pull + ridge * (s["next"] - 1)) / (1 + ridge)))
        return F.struct(moved.alias("rate"), (moved + F.element_at(r, -1) * (moved - s["rate"])).alias("next"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("next")), step)


def _trail(steps: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in r]) for r in steps]) if steps else F.array().cast("array<array<double>>")


def fit_rates(groups: DataFrame, targets: tuple[float, ...], ridge: float = 1e-4, max_rate: float = 4.0, rounds: int = 60, tolerance: float = 1e-4, reach: float = 1.0) -> list[list[float]]:
    """Steps of accelerated projected gradient descent for groups(tokens, p); see `fold_rate`.

    Minimises sum over domains of (expected tokens - target tokens)^2 / available tokens, plus a small pull
    of rates towards 1. The token budget is the one at which the domain with the largest target is used at
    rate 1, times `reach`. Ends when no residual is or moves by more than `tolerance`; momentum restarts when it overshoots.
    """
    k = len(targets)
    if k != len(DOMAINS):
        raise ValueError(f"{len(DOMAINS)} targets are needed")
    sums = lambda rate: [F.sum(F.col("tokens") * F.col("p")[d] * rate).alias(f"s{d}") for d in range(k)]
    have = [x or 0.0 for x in groups.agg(*sums(F.lit(1.0))).first()]
    anchor = max(range(k), key=lambda d: (targets[d], -d))
    budget = reach * have[anchor] / targets[anchor] if have[anchor] else 0.0
    steps: list[list[float]] = []
    before, t = math.inf, 1.0
    for _ in range(rounds if budget else 0):
        now = groups.agg(*sums(fold_rate(F.col("p"), _trail(steps), ridge, max_rate)["next"])).first()
        residual = [(now[d] - targets[d] * budget) / have[d] if have[d] else 0.0 for d in range(k)]
        if max(map(abs, residual)) < tolerance or (steps and max(abs(a - b) for a, b in zip(residual, steps[-1][:k], strict=True)) < tolerance / 10):
            break
        loss = sum(have[d] * residual[d] ** 2 for d in range(k))
        t = 1.0 if loss > before else t
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        steps.append([*residual, (t - 1) / after])
        before, t = loss, after
    return steps


def mix(docs: DataFrame, model: Model, targets: tuple[float, ...], max_rate: float = 4.0, snap: float = 0.0, ridge: float = 1e-4, reach: float = 1.0) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, p_clean, p_low, p_toxic, rate and copies.

    copies is the rate rounded at random by a hash of doc_id and text, so that the expected totals of copies are those of
    the rates. With snap above 0 a rate within `snap` of a whole number is rounded to it instead, which keeps
    documents at a rate near 1 whole but moves totals by up to that share. With max_rate 1 and a reach above 1 the
    largest domain is asked for more than it holds, so its documents come to the bound by the fit itself.
    """
    folder = work_dir(docs.sparkSession, "mixing")
    found = pick(docs, "doc_id", "text").withColumn("_key", F.xxhash64(F.lit("mix"), "doc_id", "text"))
    found = written(features(found, model.lexicon), f"{folder}/features")
    bins = list(BINS)
    groups = found.groupBy(*bins).agg(F.sum("n_words").cast("double").alias("tokens"))
    groups = written(posteriors(groups, model).select("tokens", "p"), f"{folder}/groups")
    steps = fit_rates(groups, targets, ridge, max_rate, reach=reach)
    rates = posteriors(found.select(*bins).distinct(), model).withColumn("rate", fold_rate(F.col("p"), _trail(steps), ridge, max_rate)["rate"])
    # at most one row for each combination of bins: a few thousand
    out = found.join(F.broadcast(rates), bins)
    near = F.round("rate")
    chance = F.floor(F.col("rate") + F.pmod(F.col("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    copies = F.when(F.abs(F.col("rate") - near) <= snap, near).otherwise(chance).cast("int")
    shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return out.select("doc_id", "n_words", *shares, "rate", copies.alias("copies"))
