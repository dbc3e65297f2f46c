"""Offline ranking metrics and the report of a prediction log.

Candidates: (query_id, slug, score, base_logit, residual, is_positive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 6


def _logsumexp(x: Column, top: Column) -> Column:
    return F.log(F.sum(F.exp(x - top))) + F.max(top)


def per_query(candidates: DataFrame) -> DataFrame:
    """One row per query with everything the losses need; a query without positives has null ``positive``."""
    score, base, positive = F.col("score"), F.col("base_logit"), F.col("is_positive")
    #: Of equal base logits the first slug's counts.
    tops = candidates.groupBy("query_id").agg(
        F.max("score").alias("top"), F.max("base_logit").alias("base_top"), F.max(F.when(positive, score)).alias("best_positive"),
        F.max(F.when(~positive, score)).alias("best_negative"), F.min_by("is_positive", F.struct((-F.col("base_logit")).alias("b"), "slug")).alias("base_correct"),
    )
    rows = candidates.join(tops, "query_id")
    sums = rows.groupBy("query_id").agg(
        F.first("best_positive").alias("best_positive"), F.first("best_negative").alias("best_negative"), F.first("base_correct").alias("base_correct"), F.count("*").alias("n"),
        _logsumexp(score, F.col("top")).alias("all"), _logsumexp(base, F.col("base_top")).alias("base_all"),
        (F.log(F.sum(F.when(positive, F.exp(score - F.col("best_positive"))))) + F.max("best_positive")).alias("positive"),
        F.sum(F.exp(base - F.col("base_top")) * (base - score)).alias("_gap"), F.sum(F.exp(base - F.col("base_top"))).alias("_mass"),
        F.sum(F.col("residual") * F.col("residual")).alias("residual_squares"),
    )
    #: KL(base || final) = E_base[base - final] - logZ_base + logZ_final
    kl = F.col("_gap") / F.col("_mass") - F.col("base_all") + F.col("all")
    return sums.withColumn("kl", kl).drop("_gap", "_mass")


def ranking_report(
    candidates: DataFrame, pairwise: float = 0.25, protection: float = 0.75, guard: float = 0.02, margin: float = 0.5, batch_width: int | None = None, padded: bool = True, strict: bool = False
) -> DataFrame:
    """(n_queries, ranking, pairwise, base_correct_rate, protection, residual_guard, total).

    ``ranking`` is the listwise cross-entropy over accepted answers (queries without one are left out, or an error if ``strict``), ``pairwise`` the
    softplus loss against the hardest negative, ``protection`` the mean KL of queries that the base ranks right and ``residual_guard``
    their mean squared residual: per padded cell of a batch ``batch_width`` wide (the longest query by default), or per candidate.
    """
    rows = per_query(candidates)
    if strict:
        stop = F.raise_error(F.concat(F.lit("query without a positive candidate: "), F.col("query_id").cast("string"))).cast("double")
        rows = rows.withColumn("positive", F.when(F.col("positive").isNull(), stop).otherwise(F.col("positive")))
    right = F.coalesce("base_correct", F.lit(False))
    loss = F.log1p(F.exp(F.lit(margin) - F.col("best_positive") + F.col("best_negative")))
    width = F.lit(batch_width) if batch_width else F.max("n")
    cells = F.count_if(right) * width if padded else F.sum(F.when(right, F.col("n")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    parts = rows.agg(
        F.count("*").alias("n_queries"), zero(F.avg(F.col("all") - F.col("positive"))).alias("ranking"), zero(F.avg(loss)).alias("pairwise"),
        zero(F.avg(right.cast("double"))).alias("base_correct_rate"), zero(F.avg(F.when(right, F.col("kl")))).alias("protection"),
        zero(F.try_divide(F.sum(F.when(right, F.col("residual_squares"))), cells)).alias("residual_guard"),
    )
    total = F.col("ranking") + pairwise * F.col("pairwise") + protection * F.col("protection") + guard * F.col("residual_guard")
    names = ["ranking", "pairwise", "base_correct_rate", "protection", "residual_guard", "total"]
    return parts.withColumn("total", total).select("n_queries", *(F.round(c, SCALE).alias(c) for c in names))


def log_summary(predictions: DataFrame, exact: bool = True) -> DataFrame:
    """(n, answered, abstained, images, latency min, mean, p50, p90, p95, p99, max) of a prediction log.

    Exact percentiles keep one count per distinct latency, of which whole milliseconds have few; other logs take ``exact=False``.
    """
    at = (lambda p: F.percentile("latency_ms", F.lit(p))) if exact else (lambda p: F.percentile_approx("latency_ms", p, 10_000).cast("double"))
    return predictions.agg(
        F.count("*").alias("n"), F.count("predicted_slug").alias("answered"), F.count_if(F.col("predicted_slug").isNull()).alias("abstained"), F.count_distinct("image_sha256").alias("images"),
        F.min("latency_ms").alias("latency_min"), F.round(F.avg("latency_ms"), SCALE).alias("latency_mean"), F.max("latency_ms").alias("latency_max"),
        *(F.round(at(p), SCALE).alias(f"latency_p{round(100 * p)}") for p in (0.5, 0.9, 0.95, 0.99)),
    )


#: Sizes of the sketches: 2**12 registers tell distinct counts within 5 in 100 (three standard errors), 2**9 items quantiles within 1.4 in 100 of the rank.
HLL_BITS, KLL_ITEMS = 12, 512


def log_sketches(predictions: DataFrame, day: str = "day") -> DataFrame:
    """A row per day of a prediction log: counts, sums and extremes, and sketches of its latencies and distinct images.

    Days are kept; a day's later rows make a row of their own beside it, and ``merged_summary`` adds up whatever it is given.
    """
    return predictions.groupBy(F.col(day).alias("day")).agg(
        F.count("*").alias("n"), F.count("predicted_slug").alias("answered"), F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"),
        F.sum("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("timed"),
        F.hll_sketch_agg("image_sha256", F.lit(HLL_BITS)).alias("images"), F.kll_sketch_agg_bigint("latency_ms", F.lit(KLL_ITEMS)).alias("latencies"),
    )


def merged_summary(sketches: DataFrame, by: tuple[str, ...] = (), percentiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """``log_summary`` of any range or grouping of days, from their sketches alone; ``images`` and percentiles are estimates.

    The estimate of distinct images is within 5 in 100; a percentile is a latency whose rank is within 1.4 in 100 of the asked one.
    """
    merged = sketches.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("answered"), F.lit(0)).alias("answered"), F.min("latency_min").alias("latency_min"), F.max("latency_max").alias("latency_max"),
        F.round(F.sum("latency_sum") / F.sum("timed"), SCALE).alias("latency_mean"), F.hll_union_agg("images").alias("s"), F.kll_merge_agg_bigint("latencies").alias("k"),
    )
    at = lambda p: F.when(F.col("latency_min").isNotNull(), F.kll_sketch_get_quantile_bigint("k", F.lit(p)))
    return merged.select(
        *by, "n", "answered", (F.col("n") - F.col("answered")).alias("abstained"), F.when(F.col("n") > 0, F.hll_sketch_estimate("s")).otherwise(0).alias("images"), "latency_min", "latency_mean", "latency_max",
        *(at(p).alias(f"latency_p{round(100 * p)}") for p in percentiles),
    )


def repeated_images(predictions: DataFrame) -> DataFrame:
    """(image_sha256, n, answers, consistent) of images asked about more than once; no answer is an answer of its own."""
    rows = predictions.groupBy("image_sha256").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("predicted_slug", F.lit("∅"))).alias("answers"))
    return rows.where("n > 1").withColumn("consistent", F.col("answers") == 1)


def truth_report(predictions: DataFrame, truth: DataFrame, by: str = "split") -> DataFrame:
    """(by, n, correct, correct_abstain, wrong, missed, accuracy): predictions against (query_id, true_slug or null, split)."""
    rows = truth.join(predictions.select("query_id", "predicted_slug"), "query_id", "left")
    same, says, has = F.col("predicted_slug") == F.col("true_slug"), F.col("predicted_slug").isNotNull(), F.col("true_slug").isNotNull()
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(same).alias("correct"), F.count_if(~says & ~has).alias("correct_abstain"),
        F.count_if(says & ~F.coalesce(same, F.lit(False))).alias("wrong"), F.count_if(~says & has).alias("missed"),
        F.round(F.avg(F.coalesce(same, ~says & ~has).cast("double")), SCALE).alias("accuracy"),
    )


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, answered, correct, correct_abstain, wrong) if answers were given from that confidence on; ``scored`` (query_id, slug, confidence, true_slug)."""
    rows = scored.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    says = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    same = F.coalesce(F.col("slug") == F.col("true_slug"), F.lit(False))
    return rows.groupBy("threshold").agg(
        F.count_if(says).alias("answered"), F.count_if(says & same).alias("correct"), F.count_if(~says & F.col("true_slug").isNull()).alias("correct_abstain"), F.count_if(says & ~same).alias("wrong")
    )
