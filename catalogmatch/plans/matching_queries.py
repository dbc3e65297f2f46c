"""Queries over embeddings: mining, fusion, confidence, status, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogmatch.functions import text as T
from catalogmatch.functions import vectors as V
from catalogmatch.operators import metrics as M
from catalogmatch.operators import mining as N
from catalogmatch.operators import resolve as R
from catalogmatch.operators.vector_index import build_index
from catalogmatch.plans.catalog_queries import GRAMS_CTE
from catalogmatch.plans.inputs import MINING, RAW_RESIDUAL, branch_vectors, labelled, table, themselves
from catalogmatch.sources.sinks import kept_table


def _sides(spark, sf):
    return branch_vectors(spark, sf, "query_id", query_set=True), branch_vectors(spark, sf, "slug")


def _mined(spark, sf):
    q, g = _sides(spark, sf)
    rows = N.marked_by_label(N.candidate_pool(q, g, exclude=themselves(spark, sf)), *labelled(spark, sf))
    return N.with_logits(rows.withColumn("raw_residual", F.expr(RAW_RESIDUAL)))


def g1_normalized(spark, sf):
    _, g = _sides(spark, sf)
    return g.select(F.col("slug").alias("vec_id"), "branch", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("norm"), F.round(F.element_at("vec", 1), 6).alias("first"))


def e4_branch_top(spark, sf):
    q, g = _sides(spark, sf)
    return N.branch_top_k(q, g, exclude=themselves(spark, sf)).select("query_id", "branch", "slug", "sim", F.col("branch_rank").cast("int").alias("branch_rank"))


def e4_indexed_top(spark, sf):
    """The same by an inverted-file index, which scores only what its bounds cannot rule out."""
    q, g = _sides(spark, sf)
    found = build_index(g).top_k(q, exclude=themselves(spark, sf))
    return found.select("query_id", "branch", "slug", "sim", F.col("branch_rank").cast("int").alias("branch_rank"))


def c5_index_recall(spark, sf):
    """Whether the nearest cells alone, as many as a sample of queries needs for 0.95 of its neighbours, hold 0.9 of all."""
    q, g = _sides(spark, sf)
    q, g = (x.where("branch = 'label'") for x in (q, g))
    index, own = build_index(g), themselves(spark, sf)
    near = index.top_k(q, exclude=own, probes=index.probes_for(q, 12, 0.95, own)["label"], exact=False)
    return N.recall_against(near, N.branch_top_k(q, g, exclude=own)).select((F.col("recall") >= 0.9).alias("reached"))


def g2_similarities(spark, sf):
    q, g = _sides(spark, sf)
    return N.similarity_ranges(q, g, themselves(spark, sf))


def f1_pool_sizes(spark, sf):
    q, g = _sides(spark, sf)
    tops = N.branch_top_k(q, g, exclude=themselves(spark, sf))
    return tops.select("query_id", "slug").distinct().groupBy("query_id").agg(F.count("*").alias("n"))


def g3_mining(spark, sf):
    return _mined(spark, sf).select("query_id", "slug", F.col("rank").cast("int").alias("rank"), "is_positive", F.col("sims")["label"].alias("sim_label"), F.col("sims")["bottle"].alias("sim_bottle"))


def d4_pool_recall(spark, sf):
    return N.pool_recall(_mined(spark, sf))


def g4_pair_features(spark, sf):
    q, g = _sides(spark, sf)
    rows = N.pair_table(_mined(spark, sf), q, g, "bottle")
    total = lambda a, n: F.round(F.aggregate(F.slice("features", a, n), F.lit(0.0), lambda s, x: s + x), 6)
    return rows.select("query_id", "slug", F.size("features").alias("width"), total(65, 32).alias("difference"), total(97, 32).alias("product"))


def g5_fused_evidence(spark, sf):
    rows = _mined(spark, sf).select("query_id", "slug", F.explode("sims").alias("branch", "value"))
    rows = rows.withColumn("available", ~((F.col("branch") == "label") & (F.col("query_id") % 40 == 0)))
    gates = spark.createDataFrame([("label", 0.4), ("bottle", 1.1)], "branch string, gate double")
    return N.fused_evidence(rows, gates)


def g5_fused_vectors(spark, sf):
    """The gallery vectors of mined candidates fused over the branches that a query has; two elements, and the square of the length."""
    _, g = _sides(spark, sf)
    rows = _mined(spark, sf).select("query_id", "slug").join(g.withColumnRenamed("vec", "value"), "slug")
    rows = rows.withColumn("available", ~((F.col("branch") == "label") & (F.col("query_id") % 40 == 0)) & (F.col("query_id") % 60 != 0))
    gates = spark.createDataFrame([("label", 0.4), ("bottle", 1.1)], "branch string, gate double")
    fused = N.fused_vectors(rows, gates)
    return fused.select("query_id", "slug", F.element_at("fused", 1).alias("first"), F.element_at("fused", -1).alias("last"), F.round(V.dot(F.col("fused"), F.col("fused")), 4).alias("square"))


def g6_logits(spark, sf):
    return _mined(spark, sf).select("query_id", "slug", "base_logit", "residual", "score")


def g7_class_logits(spark, sf):
    _, g = _sides(spark, sf)
    rows = g.where("branch = 'bottle'").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("slug"), "label"), "slug")
    return N.class_logits(rows.select(F.col("slug").alias("id"), "vec"), N.class_centroids(rows))


def g9_masked(spark, sf):
    _, g = _sides(spark, sf)
    rows = g.where("branch = 'label'").select("slug", V.masked(F.col("vec"), F.col("slug") % 3 != 0).alias("vec"))
    return rows.select(F.col("slug").alias("vec_id"), F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("norm"))


def _views(spark, sf):
    """Two views per query: the candidates as they are, and every second one with a changed score."""
    changed = F.when(F.col("slug") % 4 == 0, F.col("score")).otherwise(F.round(F.col("score") + 0.25, 6))
    second = F.when(F.col("slug") % 2 == 0, F.struct(changed.alias("score"), F.lit(2).alias("view")))
    both = F.array_compact(F.array(F.struct("score", F.lit(1).alias("view")), second))
    return _mined(spark, sf).select("query_id", "slug", F.inline(both))


def d3_view_fusion(spark, sf):
    return R.fuse_views(_views(spark, sf)).select("query_id", "slug", "view", "score")


def i6_ranking(spark, sf):
    return R.ranked(R.fuse_views(_views(spark, sf))).select("query_id", "slug", "score", F.col("rank").cast("int").alias("rank"))


def _confident(spark, sf):
    return R.confidences(R.fuse_views(_views(spark, sf)))


def e10_confidences(spark, sf):
    return _confident(spark, sf).select("query_id", "slug", F.col("rank").cast("int").alias("rank"), "confidence")


def _resolved(spark, sf):
    catalog = table(spark, sf, "embeddings").where("vec_id % 50 <> 7").select(F.col("vec_id").alias("slug"))
    queries = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 140 == 0).alias("abstain"))
    return R.resolve(queries, _confident(spark, sf), catalog)


def i7_scan_resolution(spark, sf):
    return _resolved(spark, sf)


def h19_evaluation(spark, sf):
    return R.evaluation_answers(_resolved(spark, sf))


def e14_alternatives(spark, sf):
    return R.alternatives(_resolved(spark, sf), _confident(spark, sf)).select("query_id", F.col("place").cast("int").alias("place"), "slug")


def e11_distinct_candidates(spark, sf):
    views = _views(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slug", "view")))
    return R.distinct_candidates(views).select("query_id", "slug", F.col("rank").cast("int").alias("rank"))


def i9_ranking_report(spark, sf):
    return M.ranking_report(_mined(spark, sf))


def i8_feature_table(spark, sf):
    """Query and gallery vectors with an n-gram branch where there is text, mined over three branches.

    The text on the bottle of vector v is the benchmark item whose id is v; vectors beyond the items have none.
    """
    q, g = _sides(spark, sf)
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"), "text").join(table(spark, sf, "embeddings").select("vec_id"), "vec_id", "left_semi")
    read = kept_table(T.densified(T.ngram_vectors(texts, "vec_id", "text"), "vec_id"), "ocr-vectors").select(F.col("vec_id").alias("slug"), F.lit("ocr").alias("branch"), "vec")
    q = q.unionByName(read.where("slug % 20 = 0").withColumnRenamed("slug", "query_id"))
    rows = N.marked_by_label(N.candidate_pool(q, g.unionByName(read), exclude=themselves(spark, sf)), *labelled(spark, sf))
    return rows.select("query_id", "slug", F.col("rank").cast("int").alias("rank"), "is_positive", F.col("sims")["ocr"].alias("sim_ocr"), "key")


QUERIES = {
    f.__name__: f
    for f in (
        g1_normalized, e4_branch_top, e4_indexed_top, c5_index_recall, g2_similarities, f1_pool_sizes, g3_mining, d4_pool_recall, g4_pair_features, g5_fused_evidence, g5_fused_vectors, g6_logits, g7_class_logits, g9_masked, d3_view_fusion,
        i6_ranking, e10_confidences, i7_scan_resolution, h19_evaluation, e14_alternatives, e11_distinct_candidates, i9_ranking_report, i8_feature_table,
    )
}
VIEWS = f"""WITH {MINING}, two AS (SELECT query_id, slug, score, 1 AS view FROM cands UNION ALL SELECT query_id, slug, CASE WHEN slug % 4 = 0 THEN score ELSE round(score + 0.25, 6) END, 2 FROM cands WHERE slug % 2 = 0),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slug ORDER BY score DESC, view) AS n FROM two) WHERE n = 1),
ranked AS (SELECT query_id, slug, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM fused) WHERE rank <= 10),
weights AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS w FROM ranked),
confident AS (SELECT query_id, slug, rank, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS confidence FROM weights),
kept AS (SELECT * FROM confident WHERE rank <= 5),
tops AS (SELECT query_id, max(slug) FILTER (rank = 1) AS top, max(confidence) FILTER (rank = 1) AS confidence, max(confidence) FILTER (rank = 2) AS second, count(*) AS n_candidates, bool_or(slug % 50 = 7) AS bad FROM kept GROUP BY query_id),
status AS (
  SELECT q.vec_id AS query_id, CASE WHEN bad THEN 'catalog_mismatch' WHEN q.vec_id % 140 = 0 OR confidence IS NULL THEN 'not_found' WHEN confidence >= 0.45 AND coalesce(round(confidence - second, 6) >= 0, true) THEN 'matched'
    WHEN confidence >= 0.2 THEN 'uncertain' ELSE 'not_found' END AS status, top, confidence, round(confidence - second, 6) AS margin, coalesce(n_candidates, 0) AS n_candidates
  FROM embeddings q LEFT JOIN tops t ON t.query_id = q.vec_id WHERE q.vec_id % 20 = 0
), resolved AS (SELECT query_id, status, CASE WHEN status = 'matched' THEN top END AS slug, confidence, margin, n_candidates, CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.MESSAGES.items())} END AS message FROM status)"""
_NORM = "CAST(list_sum(list_transform({0}, lambda x: x * x)) AS DOUBLE)"
FEATURES = f"""WITH {MINING}, {GRAMS_CTE}, h AS (SELECT id, md5(gram) AS m FROM grams WHERE id IN (SELECT vec_id FROM embeddings)),
e AS (SELECT id, CAST(CAST('0x' || substr(m, 1, 15) AS BIGINT) % 512 AS INT) AS bucket, CASE WHEN CAST('0x' || substr(m, 16, 1) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM h),
s AS (SELECT id, bucket, CAST(sum(sign) AS DOUBLE) AS s FROM e GROUP BY id, bucket HAVING sum(sign) <> 0),
v AS (SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS v FROM s), read AS (SELECT DISTINCT id FROM v),
ocr AS (SELECT q.id AS query_id, g.id AS slug, round(coalesce(sum(x.v * y.v), 0), 6) AS sim_ocr FROM read q JOIN read g ON q.id % 20 = 0 AND q.id <> g.id LEFT JOIN v x ON x.id = q.id LEFT JOIN v y ON y.id = g.id AND y.bucket = x.bucket GROUP BY q.id, g.id),
all3 AS (SELECT r.*, o.sim_ocr, CASE WHEN o.slug IS NOT NULL THEN row_number() OVER (PARTITION BY r.query_id, o.slug IS NOT NULL ORDER BY o.sim_ocr DESC, r.slug) END AS ro FROM ranks r LEFT JOIN ocr o ON o.query_id = r.query_id AND o.slug = r.slug),
pool3 AS (SELECT *, greatest(sim_label, sim_bottle, coalesce(sim_ocr, -1)) AS best FROM all3 WHERE rl <= 12 OR rb <= 12 OR ro <= 12),
out3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, slug) AS INT) AS place FROM pool3)"""
ORACLES = {
    "i8_feature_table": f"{FEATURES} SELECT query_id, slug, place AS rank, is_positive, sim_ocr, best AS key FROM out3 WHERE place <= 36",
    "g1_normalized": f"WITH {MINING} SELECT vec_id, 'label' AS branch, round({_NORM.format('l')}, 6) AS norm, round(l[1], 6) AS first FROM vecs UNION ALL SELECT vec_id, 'bottle', round({_NORM.format('b')}, 6), round(b[1], 6) FROM vecs",
    "e4_branch_top": f"""WITH {MINING} SELECT query_id, 'label' AS branch, slug, sim_label AS sim, CAST(rl AS INT) AS branch_rank FROM ranks WHERE rl <= 12
      UNION ALL SELECT query_id, 'bottle', slug, sim_bottle, CAST(rb AS INT) FROM ranks WHERE rb <= 12""",
    "g2_similarities": f"""WITH {MINING} SELECT query_id, 'label' AS branch, count(*) AS n, max(sim_label) AS most, min(sim_label) AS least FROM pairs GROUP BY query_id
      UNION ALL SELECT query_id, 'bottle', count(*), max(sim_bottle), min(sim_bottle) FROM pairs GROUP BY query_id""",
    "f1_pool_sizes": f"WITH {MINING} SELECT query_id, count(*) AS n FROM pool GROUP BY query_id",
    "g3_mining": f"WITH {MINING} SELECT query_id, slug, CAST(rank AS INT) AS rank, is_positive, sim_label, sim_bottle FROM cands",
    "d4_pool_recall": f"WITH {MINING}, r AS (SELECT query_id, bool_or(is_positive) AS n FROM cands GROUP BY query_id) SELECT count(*) AS n_queries, round(avg(CAST(n AS DOUBLE)), 6) AS recall FROM r",
    "g4_pair_features": f"""WITH {MINING} SELECT c.query_id, c.slug, 128 AS width, round(list_sum(list_transform(list_zip(q.b, g.b), lambda x: abs(x[1] - x[2]))), 6) AS difference,
      round(list_sum(list_transform(list_zip(q.b, g.b), lambda x: x[1] * x[2])), 6) AS product FROM cands c JOIN vecs q ON q.vec_id = c.query_id JOIN vecs g ON g.vec_id = c.slug""",
    "g5_fused_evidence": f"""WITH {MINING}, w AS (SELECT query_id, slug, sim_label, sim_bottle, CASE WHEN query_id % 40 = 0 THEN 0.0 ELSE exp(0.4 - 1.1) END AS wl FROM cands)
      SELECT query_id, slug, round((wl * sim_label + sim_bottle) / greatest(wl + 1, 1e-6), 6) AS fused FROM w""",
    "g6_logits": f"WITH {MINING} SELECT query_id, slug, base_logit, residual, score FROM cands",
    "g7_class_logits": f"""WITH {MINING}, cells AS (SELECT label, i, avg(b[i]) AS v FROM vecs, range(1, 33) t(i) GROUP BY label, i), cent AS (SELECT label, list(v ORDER BY i) AS c FROM cells GROUP BY label)
      SELECT v.vec_id AS id, c.label, round(list_dot_product(v.b, c.c) / sqrt(list_sum(list_transform(c.c, lambda x: x * x))) / 0.07, 4) AS logit FROM vecs v, cent c""",
    "g9_masked": f"WITH {MINING} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round({_NORM.format('l')}, 6) END AS norm FROM vecs",
    "d3_view_fusion": f"{VIEWS} SELECT query_id, slug, view, score FROM fused",
    "i6_ranking": f"{VIEWS} SELECT query_id, slug, score, rank FROM ranked",
    "e10_confidences": f"{VIEWS} SELECT * FROM kept",
    "i7_scan_resolution": f"{VIEWS} SELECT * FROM resolved",
    "h19_evaluation": f"{VIEWS} SELECT query_id, slug AS predicted_slug FROM resolved",
    "e14_alternatives": f"""{VIEWS}, o AS (SELECT k.query_id, k.slug, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS place FROM kept k JOIN resolved r ON r.query_id = k.query_id AND k.slug IS DISTINCT FROM r.slug)
      SELECT query_id, CAST(place AS INT) AS place, slug FROM o WHERE place <= 3""",
    "e11_distinct_candidates": f"""{VIEWS}, f AS (SELECT query_id, slug, max(score) AS s FROM two GROUP BY query_id, slug), r AS (SELECT query_id, slug, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, slug) AS INT) AS rank FROM f)
      SELECT * FROM r WHERE rank <= 5""",
    "i9_ranking_report": f"""WITH {MINING}, t AS (SELECT *, max(score) OVER q AS top, max(base_logit) OVER q AS btop, row_number() OVER (PARTITION BY query_id ORDER BY base_logit DESC, slug) AS br FROM cands WINDOW q AS (PARTITION BY query_id)),
      s AS (SELECT query_id, count(*) AS n, ln(sum(exp(score - top))) + max(top) AS a, ln(sum(exp(base_logit - btop))) + max(btop) AS ba, ln(sum(exp(score - top)) FILTER (is_positive)) + max(top) AS p,
        max(score) FILTER (is_positive) AS bp, max(score) FILTER (NOT is_positive) AS bn, bool_or(is_positive) FILTER (br = 1) AS good, sum(exp(base_logit - btop) * (base_logit - score)) / sum(exp(base_logit - btop)) AS gap, sum(residual * residual) AS rs
        FROM t GROUP BY query_id),
      m AS (SELECT count(*) AS n_queries, coalesce(avg(a - p), 0) AS ranking, coalesce(avg(ln(1 + exp(0.5 - bp + bn))), 0) AS pairwise, avg(CAST(good AS DOUBLE)) AS base_correct_rate, coalesce(avg(gap - ba + a) FILTER (good), 0) AS protection,
        coalesce(sum(rs) FILTER (good) / nullif(count(*) FILTER (good) * max(n), 0), 0) AS residual_guard FROM s)
      SELECT n_queries, round(ranking, 6) AS ranking, round(pairwise, 6) AS pairwise, round(base_correct_rate, 6) AS base_correct_rate, round(protection, 6) AS protection, round(residual_guard, 6) AS residual_guard,
        round(ranking + 0.25 * pairwise + 0.75 * protection + 0.02 * residual_guard, 6) AS total FROM m""",
}
ORACLES |= {"e4_indexed_top": ORACLES["e4_branch_top"], "c5_index_recall": "SELECT true AS reached"}
ORACLES |= {
    "g5_fused_vectors": f"""WITH {MINING}, w AS (SELECT c.query_id, c.slug, v.l, v.b, CASE WHEN c.query_id % 40 = 0 OR c.query_id % 60 = 0 THEN 0.0 ELSE exp(0.4 - 1.1) END AS wl, CASE WHEN c.query_id % 60 = 0 THEN 0.0 ELSE 1.0 END AS wb FROM cands c JOIN vecs v ON v.vec_id = c.slug),
      f AS (SELECT query_id, slug, list_transform(range(1, 33), lambda i: CASE WHEN wb = 0 THEN 0.0 ELSE round((wl * l[i] + wb * b[i]) / greatest(wl + wb, 1e-6), 6) END) AS fused FROM w)
      SELECT query_id, slug, CAST(fused[1] AS DOUBLE) AS first, CAST(fused[32] AS DOUBLE) AS last, round(CAST(list_sum(list_transform(fused, lambda x: x * x)) AS DOUBLE), 4) AS square FROM f""",
}
