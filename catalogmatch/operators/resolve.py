"""From ranked candidates to an answer: fusion over views, confidence, catalog check, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages by status.
MESSAGES = {
    "matched": "Вино найдено в каталоге.",
    "uncertain": "Есть несколько похожих этикеток. Снимите название и год крупнее — пока точный результат не подтверждён.",
    "not_found": "Не удалось найти вино. Снимите этикетку крупнее, без бликов и соседних бутылок.",
    "catalog_mismatch": "Каталог и модель не синхронизированы. В ответе есть неизвестное вино.",
}


def fuse_views(records: DataFrame, key: str = "query_id") -> DataFrame:
    """The best-scoring record of every (query, slug); of equal scores the earliest view's."""
    w = Window.partitionBy(key, "slug").orderBy(F.desc("score"), "view")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(records: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """The ``k`` best records of each query with rank from 1; ties by slug."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "slug")
    return records.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def confidences(records: DataFrame, pool: int = 10, emitted: int = 5, key: str = "query_id") -> DataFrame:
    """Softmax over the ``pool`` best scores, of which the first ``emitted`` are kept as they are."""
    top = ranked(records, pool, key)
    w = Window.partitionBy(key)
    weight = F.exp(F.col("score") - F.max("score").over(w))
    return top.withColumn("_w", weight).withColumn("confidence", F.round(F.col("_w") / F.sum("_w").over(w), 6)).where(F.col("rank") <= emitted).drop("_w")


def distinct_candidates(candidates: DataFrame, most: int = 5, key: str = "query_id") -> DataFrame:
    """The first occurrence of every slug, in order, re-ranked; at most ``most``."""
    first = Window.partitionBy(key, "slug").orderBy("rank")
    again = Window.partitionBy(key).orderBy("rank")
    rows = candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= most)


def status(confidence: Column, margin: Column, abstain: Column, sure: float = 0.45, suggest: float | None = 0.20, least_margin: float = 0.0) -> Column:
    """matched, uncertain or not_found; a missing margin (a single candidate) passes."""
    answers = confidence.isNotNull() & ~F.coalesce(abstain, F.lit(False))
    out = F.when(answers & (confidence >= sure), F.when(F.coalesce(margin >= least_margin, F.lit(True)), "matched").otherwise("uncertain"))
    if suggest is not None:
        out = out.when(answers & (confidence >= suggest), "uncertain")
    return out.otherwise("not_found")


def resolve(
    queries: DataFrame, candidates: DataFrame, catalog: DataFrame, sure: float = 0.45, suggest: float | None = 0.20, least_margin: float = 0.0, strict: bool = False
) -> DataFrame:
    """(query_id, status, slug, confidence, margin, n_candidates, message) of every query.

    ``queries`` (query_id, abstain), ``candidates`` (query_id, rank, slug, confidence). An unknown slug among the first five makes
    the query a ``catalog_mismatch`` (an error if ``strict``); it is never skipped in favour of a lower rank.
    """
    kept = distinct_candidates(candidates)
    known = catalog.select("slug").distinct().withColumn("known", F.lit(True))
    kept = kept.join(known, "slug", "left")
    tops = kept.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("slug"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("confidence"),
        F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"),
        F.count("*").alias("n_candidates"),
        F.bool_or(F.col("known").isNull()).alias("unknown"),
    )
    rows = queries.select("query_id", "abstain").join(tops, "query_id", "left").withColumn("margin", F.round(F.col("confidence") - F.col("second"), 6))
    mismatch = F.coalesce("unknown", F.lit(False))
    stop = F.raise_error(F.concat(F.lit("unknown slug among the candidates of query "), F.col("query_id").cast("string"))).cast("string")
    verdict = F.when(mismatch, stop if strict else F.lit("catalog_mismatch")).otherwise(status(F.col("confidence"), F.col("margin"), F.col("abstain"), sure, suggest, least_margin))
    rows = rows.withColumn("status", verdict)
    message = F.coalesce(*(F.when(F.col("status") == s, m) for s, m in MESSAGES.items()))
    return rows.select(
        "query_id", "status", F.when(F.col("status") == "matched", F.col("top")).alias("slug"), "confidence", "margin", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), message.alias("message")
    )


def evaluation_answers(resolved: DataFrame) -> DataFrame:
    """(query_id, predicted_slug): the matched slug, else null."""
    return resolved.select("query_id", F.when(F.col("status") == "matched", F.col("slug")).alias("predicted_slug"))


def alternatives(resolved: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, place, slug): the first candidates other than the shown one."""
    shown = resolved.select("query_id", F.col("slug").alias("shown"))
    rows = distinct_candidates(candidates).join(shown, "query_id").where(~F.col("slug").eqNullSafe(F.col("shown")))
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "place", "slug")
