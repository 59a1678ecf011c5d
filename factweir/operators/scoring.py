"""Index of a run: weighted means over scored categories, coverage rules and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category weights; the first three are measured, the others judged.
WEIGHTS = {
    "energy_throughput": 0.30, "compute_capacity": 0.20, "growth": 0.15,
    "frontier_acceleration": 0.15, "builder_velocity": 0.12, "policy_stance": 0.08,
}
MEASURED = ("energy_throughput", "compute_capacity", "growth")
ORDINALS = {k: i for i, k in enumerate(WEIGHTS)}
UNDISCLOSED_CONFIDENCE = 0.8


def weight_of(category: Column) -> Column:
    """Weight of a category, null if it isn't listed."""
    return F.coalesce(*[F.when(category == k, w) for k, w in WEIGHTS.items()])


def fixed(x: Column, digits: int) -> Column:
    """Rounded half up on the binary value; tiny sums of weights come out whole."""
    return F.floor(x * 10**digits + 0.5 + 1e-9) / 10**digits


def share_failure(share: Column, confidence: Column, min_share: float, min_confidence: float) -> Column:
    """Why the quality gate fails (both bounds are strict), or null."""
    return F.when(~(fixed(F.coalesce(share, F.lit(0.0)), 4) > min_share), "too little measured data").when(~(fixed(F.coalesce(confidence, F.lit(0.0)), 4) > min_confidence), "low confidence")


def aggregate_index(scores: DataFrame, min_coverage: float = 0.6, min_measured: float = 0.3, min_share: float = 0.4, min_confidence: float = 0.2) -> DataFrame:
    """scores(run_id, category, score, confidence) to one row for each run: index, parts, verdict.

    A run without an energy score is measured against the other weights, with its confidence reduced.
    """
    s = scores.withColumn("w", weight_of(F.col("category"))).withColumn("measured", F.col("category").isin(*MEASURED))
    s = s.withColumn("p", F.when(F.col("score").isNotNull(), F.col("w")))
    mean = lambda cond: fixed(F.sum(F.when(cond, F.col("p") * F.col("score"))) / F.nullif(F.sum(F.when(cond, F.col("p"))), F.lit(0.0)), 2)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    agg = s.groupBy("run_id").agg(
        mean(F.lit(True)).alias("index_score"),
        mean(F.col("measured")).alias("measured_score"),
        mean(~F.col("measured")).alias("judged_score"),
        fixed(total(F.col("p")), 4).alias("coverage"),
        fixed(total(F.when(F.col("measured"), F.col("p"))), 4).alias("measured_coverage"),
        fixed(total(F.col("p") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))), 3).alias("confidence"),
        F.coalesce(F.max(F.when(F.col("p").isNotNull(), F.col("category") == "energy_throughput")), F.lit(False)).alias("has_energy"),
    )
    agg = agg.withColumn("short", F.when(F.col("coverage") < min_coverage, "insufficient data").when(F.col("measured_coverage") < min_measured, "insufficient measured data"))
    undisclosed = F.col("short").isNotNull() & ~F.col("has_energy")
    adjusted = fixed(F.col("coverage") / (1 - WEIGHTS["energy_throughput"]), 4)
    enough = (adjusted >= min_coverage) & (F.col("measured_coverage") >= min(WEIGHTS[k] for k in MEASURED[1:]) - 1e-9)
    agg = agg.withColumns({"basis": F.when(undisclosed, "energy_undisclosed").otherwise("standard"), "adjusted_coverage": F.when(undisclosed, adjusted), "relaxed": undisclosed & enough})
    agg = agg.withColumn("confidence", F.when(F.col("relaxed"), fixed(F.col("confidence") * UNDISCLOSED_CONFIDENCE, 3)).otherwise(F.col("confidence")))
    share = fixed(F.col("measured_coverage") / F.nullif(F.col("coverage"), F.lit(0.0)), 4)
    gate = share_failure(share, F.col("confidence"), min_share, min_confidence)
    reason = F.when(F.col("relaxed"), gate).when(undisclosed, "insufficient data: energy undisclosed").when(F.col("short").isNotNull(), F.col("short")).otherwise(gate)
    agg = agg.withColumn("reason", reason).withColumn("ranked", F.col("reason").isNull())
    return agg.select("run_id", "index_score", "measured_score", "judged_score", "coverage", "measured_coverage", "confidence", "basis", "adjusted_coverage", "ranked", "reason")


def rank_status(runs: DataFrame, min_share: float = 0.4, min_confidence: float = 0.2) -> DataFrame:
    """runs with `is_ranked` and `rank_reason`: the stored verdict and today's quality gate."""
    share = fixed(F.col("measured_coverage") / F.nullif(F.col("coverage"), F.lit(0.0)), 4)
    gate = share_failure(share, F.col("confidence"), min_share, min_confidence)
    stored = F.coalesce(F.regexp_replace("reason", "; retry scheduled$", ""), F.lit("insufficient data"))
    why = F.when(~F.coalesce("ranked", F.lit(False)), stored).otherwise(gate)
    return runs.withColumn("rank_reason", why).withColumn("is_ranked", F.col("rank_reason").isNull())


def score_band(score: Column) -> Column:
    return F.when(score >= 8, "leading").when(score >= 6, "strong").when(score >= 4, "moderate").when(score.isNotNull(), "low")


def judge_confidence(confidence: Column, ids: Column) -> Column:
    """Stated confidence, capped, and damped when it rests on fewer than three distinct pieces."""
    return F.least(confidence, F.lit(0.85)) * (0.6 + 0.4 * F.least(F.lit(1.0), F.size(F.array_distinct(ids)) / 3))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost in dollars by the price of the longest matching model prefix, per million tokens."""
    out = F.lit(None).cast("double")
    for prefix, (a, b) in sorted(prices.items(), key=lambda x: len(x[0])):
        out = F.when(F.startswith(model, F.lit(prefix)), (tokens_in * a + tokens_out * b) / 1e6).otherwise(out)
    return out
