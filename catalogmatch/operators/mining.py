"""Candidate mining over several embedding branches: similarity blocks, top-k per branch, pooled and ranked candidates.

Vectors in long form: queries (query_id, branch, vec), gallery (slug, branch, vec); a query without a row (or with a null
vector) in a branch has no evidence there. Similarities are rounded to ``DIGITS`` places so that equal ones tie whatever the
order of summation; ties go by slug.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.operators.pairing import first_per_group
from catalogmatch.functions.vectors import base_logit, dot, masked, normalized, pair_features, residual_logit

DIGITS = 6
GALLERY_ROWS, QUERY_ROWS = 10_000, 5_000
#: Pairs that a task holds as one matrix (8 MB), of which ranking makes about ten.
MOST_PAIRS = 1 << 20


def block_rows(most: int, width: int) -> int:
    """How many rows of a matrix of ``width`` columns are worked on at a time: ``most``, or as many as ``MOST_PAIRS`` allow."""
    return max(1, min(most, MOST_PAIRS // max(1, width)))


def _rounded(block: pd.DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The similarities of a block of queries to the columns of ``matrix``, rounded in place."""
    sims = np.stack(block["vec"].to_list()) @ matrix
    np.round(sims, DIGITS, out=sims)
    sims += 0.0
    return sims


def prepared(vectors: DataFrame, valid: Column | None = None) -> DataFrame:
    """Unit vectors as doubles; where ``valid`` is false they are zeros."""
    vec = F.transform("vec", lambda x: x.cast("double"))
    return vectors.where("vec IS NOT NULL").withColumn("vec", normalized(masked(vec, valid) if valid is not None else vec))


def similarities(queries: DataFrame, gallery: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, slug, branch, sim) of every pair, by expressions: readable, for small query sets."""
    q = queries.select("query_id", "branch", F.col("vec").alias("qv"))
    pairs = q.join(gallery.select("slug", "branch", F.col("vec").alias("gv")), "branch")
    if exclude is not None:
        pairs = pairs.join(exclude, ["query_id", "slug"], "left_anti")
    return pairs.select("query_id", "slug", "branch", F.round(dot(F.col("qv"), F.col("gv")), DIGITS).alias("sim"))


def top_k(sims: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` best of every (query, branch), with ``branch_rank``."""
    w = Window.partitionBy("query_id", "branch").orderBy(F.desc("sim"), "slug")
    return sims.withColumn("branch_rank", F.row_number().over(w)).where(F.col("branch_rank") <= k)


def _dealt(queries: DataFrame, gallery: DataFrame, gallery_parts: int | None, query_parts: int | None, extra: list[str] = (), parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides in parts: queries with gp and qp, the gallery under names of its own (both may come from one table) with g_gp and g_qp.

    ``parts`` (branch, gallery_parts, query_parts) has numbers for each branch.
    """
    if parts is not None:
        queries, gallery = queries.join(F.broadcast(parts), "branch"), gallery.join(F.broadcast(parts), "branch")  # one row per branch
        of_gallery, of_queries = F.col("gallery_parts"), F.col("query_parts")
    else:
        if not (gallery_parts and query_parts):
            sides = queries.select("branch", F.lit(1).alias("q"), F.lit(0).alias("g")).unionByName(gallery.select("branch", F.lit(0).alias("q"), F.lit(1).alias("g")))
            largest = sides.groupBy("branch").agg(F.sum("q").alias("q"), F.sum("g").alias("g")).agg(F.coalesce(F.max("q"), F.lit(0)), F.coalesce(F.max("g"), F.lit(0))).first()
            query_parts, gallery_parts = query_parts or max(1, -(-largest[0] // QUERY_ROWS)), gallery_parts or max(1, -(-largest[1] // GALLERY_ROWS))
        of_gallery, of_queries = F.lit(gallery_parts), F.lit(query_parts)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.withColumn("qp", dealt("query_id", of_queries)).withColumn("gp", every(of_gallery)).drop("gallery_parts", "query_parts")
    right = gallery.select(*(F.col(c).alias(f"g_{c}") for c in ("slug", "branch", "vec", *extra)), dealt("slug", of_gallery).alias("g_gp"), every(of_queries).alias("g_qp"))
    return left, right


def similarity_ranges(queries: DataFrame, gallery: DataFrame, exclude: DataFrame | None = None, query_block: int = 512, gallery_parts: int | None = None, query_parts: int | None = None) -> DataFrame:
    """(query_id, branch, n, most, least): number and range of a query's similarities, by matrix products of parts.

    ``exclude`` (query_id, slug) pairs are left out; a query has few of them.
    """
    q_type, s_type = queries.schema["query_id"].dataType.simpleString(), gallery.schema["slug"].dataType.simpleString()
    rows = queries.select("query_id", "branch", "vec")
    if exclude is not None:
        rows = rows.join(exclude.groupBy("query_id").agg(F.collect_set("slug").alias("out")), "query_id", "left")
    rows = rows.withColumn("out", F.coalesce("out" if exclude is not None else F.lit(None), F.array()).cast(f"array<{s_type}>"))
    left, right = _dealt(rows, gallery, gallery_parts, query_parts)

    def ranges(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(g):
            matrix, at = np.stack(g["g_vec"].to_list()).T, {s: k for k, s in enumerate(g["g_slug"])}
            step = block_rows(query_block, len(g))
            for start in range(0, len(q), step):
                block = q.iloc[start : start + step]
                sims = _rounded(block, matrix)
                for k, out in enumerate(block["out"]):
                    sims[k, [at[s] for s in out if s in at]] = np.nan
                n = np.count_nonzero(~np.isnan(sims), axis=1)
                some = n > 0
                found.append(pd.DataFrame({"query_id": block["query_id"][some], "branch": block["branch"][some], "n": n[some], "most": np.nanmax(sims[some], axis=1), "least": np.nanmin(sims[some], axis=1)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "branch": [], "n": [], "most": [], "least": []})

    parts = left.groupBy("branch", "qp", "gp").cogroup(right.groupBy("g_branch", "g_qp", "g_gp")).applyInPandas(ranges, f"query_id {q_type}, branch string, n long, most double, least double")
    return parts.groupBy("query_id", "branch").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))


def _first_of_producers(sims: np.ndarray, codes: np.ndarray, shares: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``most`` best similarities, best first, of which a producer (``codes``, a number per column) has at most the row's ``shares``; equal ones by column.

    Only the best columns are put in order, four for each place. Where these fill too few places, some producer has had its share: its
    other columns are closed, and the best of the open ones are next. So a row is passed over at most once for each place and once more.
    """
    n, lowest = sims.shape[1], np.finfo(float).min
    width, waiting, found = min(n, 4 * most), np.arange(len(sims)), []
    have, left = np.zeros(len(sims), int), np.where(np.isnan(sims), lowest, sims)
    while len(waiting):
        #: All that reach the last place, and as many that equal it as there are places: what is left out comes after each of them.
        last = np.maximum(np.partition(left, n - width, axis=1)[:, n - width], lowest)
        rows, order = np.nonzero(left >= last[:, None])
        every = np.bincount(rows, minlength=len(waiting)) < width
        tied = left[rows, order] == last[rows]
        before = np.cumsum(tied) - tied
        near = ~tied | (before - before[np.searchsorted(rows, rows)] < width)
        rows, order = rows[near], order[near]
        by_row = np.lexsort((-left[rows, order], rows))
        rows, order = rows[by_row], order[by_row]
        #: A column's place among its producer's columns, best first, decides whether it counts.
        group = rows * n + codes[order]
        by_group = np.argsort(group, kind="stable")
        place = np.empty_like(by_group)
        place[by_group] = np.arange(len(group)) - np.searchsorted(group[by_group], group[by_group])
        fits = place < shares[waiting[rows]]
        rows, order, place = rows[fits], order[fits], place[fits]
        done = (have[waiting] + np.bincount(rows, minlength=len(waiting)) >= most) | every | (width == n)
        closed, at = np.zeros((len(waiting), n), bool), place == shares[waiting[rows]] - 1
        closed[rows[at], codes[order[at]]] = True
        final = done[rows] | closed[rows, codes[order]]
        found.append((waiting[rows[final]], order[final]))
        have[waiting] += np.bincount(rows[final], minlength=len(waiting))
        waiting, left = waiting[~done], left[~done]
        left[closed[~done][:, codes]] = -np.inf
    rows, order = np.concatenate([rows for rows, _ in found]), np.concatenate([order for _, order in found])
    by_row = np.lexsort((order, -sims[rows, order], rows))
    rows, order = rows[by_row], order[by_row]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
    return rows[first], order[first]


def branch_top_k(
    queries: DataFrame,
    gallery: DataFrame,
    k: int = 12,
    exclude: DataFrame | None = None,
    query_block: int = 512,
    gallery_parts: int | None = None,
    query_parts: int | None = None,
    per_producer: int | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """``top_k`` by matrix products, for galleries and query sets of any size.

    Both sides are dealt into parts; every pair of parts meets in one group, multiplies ``query_block`` queries at a time (fewer where the part is wide, so that no matrix exceeds ``MOST_PAIRS``) and keeps
    its own best, and the best of those win. ``exclude`` (query_id, slug) pairs are left out; each query may have up to ``k``
    more of them in a part than are shown, so parts keep ``k`` plus the query's number of exclusions. Without given numbers
    a part of the largest branch holds about ``GALLERY_ROWS`` or ``QUERY_ROWS`` rows, by a count of both tables; ``parts``
    (branch, gallery_parts, query_parts; no other branches are searched) has numbers for each branch instead. With ``per_producer`` at most so
    many rows of a ``producer`` (a column of the gallery) count; what a part passes over for better rows of its own
    producer, the whole gallery would pass over too.
    """
    q_type, s_type = queries.schema["query_id"].dataType.simpleString(), gallery.schema["slug"].dataType.simpleString()
    left = queries.select("query_id", "branch", "vec")
    if exclude is not None:
        extra = exclude.groupBy("query_id").agg(F.count("*").alias("extra"))
        left = left.join(extra, "query_id", "left").withColumn("extra", F.coalesce("extra", F.lit(0)).cast("int"))
    else:
        left = left.withColumn("extra", F.lit(0))
    gallery = gallery.withColumn("producer", F.coalesce(F.col("producer").cast("string"), F.lit("")) if per_producer else F.lit(""))
    left, right = _dealt(left, gallery, gallery_parts, query_parts, ["producer"], parts)

    def best(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        ids, slugs, values, makers = [], [], [], []
        if len(q) and len(g):
            g = g.sort_values("g_slug", kind="stable")
            matrix, names, own = np.stack(g["g_vec"].to_list()).T, g["g_slug"].to_numpy(object), g["g_producer"].to_numpy(object)
            codes = np.unique(own, return_inverse=True)[1]
            step = block_rows(query_block, len(g))
            for start in range(0, len(q), step):
                block = q.iloc[start : start + step]
                sims = _rounded(block, matrix)
                extra = block["extra"].to_numpy(int)
                most = min(k + int(extra.max()), sims.shape[1])
                if per_producer:
                    rows, order = _first_of_producers(sims, codes, per_producer + extra, most)
                else:
                    #: All that reach the last place, then these alone in order.
                    last = np.partition(sims, sims.shape[1] - most, axis=1)[:, sims.shape[1] - most]
                    rows, order = np.nonzero(sims >= last[:, None])
                    by_row = np.lexsort((order, -sims[rows, order], rows))
                    rows, order = rows[by_row], order[by_row]
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    rows, order = rows[place < most], order[place < most]
                ids.append(block["query_id"].to_numpy(object)[rows])
                slugs.append(names[order])
                makers.append(own[order])
                values.append(sims[rows, order])
        if not ids:
            none = np.zeros(0, object)
            return pd.DataFrame({"query_id": none, "slug": none, "branch": none, "producer": none, "sim": np.zeros(0)})
        branch = np.full(sum(map(len, ids)), q["branch"].iloc[0], object)
        columns = {"query_id": np.concatenate(ids), "slug": np.concatenate(slugs), "branch": branch, "producer": np.concatenate(makers), "sim": np.concatenate(values)}
        return pd.DataFrame(columns, dtype=object).astype({"sim": float})

    schema = f"query_id {q_type}, slug {s_type}, branch string, producer string, sim double"
    found = left.groupBy("branch", "qp", "gp").cogroup(right.groupBy("g_branch", "g_qp", "g_gp")).applyInPandas(best, schema)
    if exclude is not None:
        found = found.join(exclude, ["query_id", "slug"], "left_anti")
    if per_producer:
        return first_per_group(found, ["query_id", "branch"], "producer", [F.desc("sim"), F.col("slug")], per_producer, k, "branch_rank").drop("producer")
    return top_k(found.drop("producer"), k)


def pooled(tops: DataFrame, queries: DataFrame, gallery: DataFrame, max_candidates: int = 36) -> DataFrame:
    """(query_id, slug, sims map<branch,double>, key, rank): the distinct union of branch tops, ranked by their best similarity.

    The similarity of a pooled candidate counts in every branch the query has, also where the candidate is not in that branch's top.
    """
    pool = tops.select("query_id", "slug").distinct()
    pairs = pool.join(queries.select("query_id", "branch", F.col("vec").alias("qv")), "query_id").join(gallery.select("slug", "branch", F.col("vec").alias("gv")), ["slug", "branch"])
    sims = pairs.select("query_id", "slug", "branch", F.round(dot(F.col("qv"), F.col("gv")), DIGITS).alias("sim"))
    rows = sims.groupBy("query_id", "slug").agg(F.map_from_entries(F.collect_list(F.struct("branch", "sim"))).alias("sims"), F.max("sim").alias("key"))
    w = Window.partitionBy("query_id").orderBy(F.desc("key"), "slug")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_candidates)


def marked(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates with ``is_positive``; positives outside the candidates are ignored."""
    flags = positives.select("query_id", "slug").distinct().withColumn("is_positive", F.lit(True))
    return candidates.join(flags, ["query_id", "slug"], "left").withColumn("is_positive", F.coalesce("is_positive", F.lit(False)))


def marked_by_label(candidates: DataFrame, query_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates with ``is_positive``: whether query (query_id, label) and candidate (slug, label) are of one label."""
    rows = candidates.join(query_labels.select("query_id", F.col("label").alias("own")), "query_id", "left").join(labels.select("slug", F.col("label").alias("theirs")), "slug", "left")
    return rows.withColumn("is_positive", F.coalesce(F.col("own") == F.col("theirs"), F.lit(False))).drop("own", "theirs")


def pool_recall(candidates: DataFrame) -> DataFrame:
    """(n_queries, recall): share of queries with a positive among their candidates."""
    per_query = candidates.groupBy("query_id").agg(F.bool_or("is_positive").alias("natural"))
    return per_query.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("natural").cast("double")), 6).alias("recall"))


def candidate_pool(queries: DataFrame, gallery: DataFrame, k: int = 12, exclude: DataFrame | None = None, blocks: bool = True) -> DataFrame:
    """Branch tops, their pool and its ranks."""
    tops = branch_top_k(queries, gallery, k, exclude) if blocks else top_k(similarities(queries, gallery, exclude), k)
    return pooled(tops, queries, gallery, 3 * k)


def mine_candidates(queries: DataFrame, gallery: DataFrame, positives: DataFrame, k: int = 12, exclude: DataFrame | None = None, blocks: bool = True) -> DataFrame:
    """Branch tops, pool, ranks and positive flags in one job."""
    return marked(candidate_pool(queries, gallery, k, exclude, blocks), positives)


def with_logits(candidates: DataFrame, branch: str = "bottle", temperature: float = 0.07, most: float = 2.5) -> DataFrame:
    """Candidates with base_logit (of one branch), residual and score; ``raw_residual`` is an input column where there is one."""
    raw = F.col("raw_residual") if "raw_residual" in candidates.columns else F.lit(0.0)
    base = base_logit(F.try_element_at("sims", F.lit(branch)), temperature)
    residual, final = residual_logit(base, raw, most)
    return candidates.withColumns({"base_logit": F.round(base, DIGITS), "residual": F.round(residual, DIGITS), "score": F.round(final, DIGITS)})


def fused_evidence(evidence: DataFrame, gates: DataFrame) -> DataFrame:
    """(query_id, slug, fused): gate-weighted mean of branch values over the branches a query has.

    ``evidence`` (query_id, slug, branch, value double, available boolean), ``gates`` (branch, gate). Weights are a softmax over the
    available branches; their sum is floored at 1e-6, without any branch the result is 0.
    """
    rows = evidence.join(F.broadcast(gates), "branch")  # one row per branch
    w = Window.partitionBy("query_id", "slug")
    gate = F.when(F.col("available"), F.col("gate"))
    weight = F.coalesce(F.exp(gate - F.max(gate).over(w)), F.lit(0.0))
    rows = rows.withColumn("w", weight)
    return rows.groupBy("query_id", "slug").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.greatest(F.sum("w"), F.lit(1e-6)), DIGITS).alias("fused"))


def fused_vectors(evidence: DataFrame, gates: DataFrame) -> DataFrame:
    """As ``fused_evidence`` for vector values (value array<double>, equal lengths): (query_id, slug, fused array<double>).

    Weighted vectors are summed element by element by the summarizer, whose partial sums are made before the shuffle. Weights are
    exponentials of the distance to the largest gate of all, which cancels; gates may differ by 700. Rows without a value count as
    unavailable; without any available branch the result is zeros, without any value there is no row.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    top = gates.agg(F.max("gate").alias("top"))
    rows = evidence.where("value IS NOT NULL").join(F.broadcast(gates.join(F.broadcast(top))), "branch")  # one row per branch
    weight = F.when(F.col("available"), F.exp(F.col("gate") - F.col("top"))).otherwise(0.0)
    rows = rows.select("query_id", "slug", weight.alias("w"), F.transform("value", lambda x: x.cast("double")).alias("value"))
    rows = rows.withColumn("weighted", array_to_vector(F.transform("value", lambda x: x * F.col("w"))))
    summed = rows.groupBy("query_id", "slug").agg(vector_to_array(Summarizer.sum(F.col("weighted"))).alias("total"), F.sum("w").alias("w"))
    return summed.select("query_id", "slug", F.transform("total", lambda x: F.when(F.col("w") > 0, F.round(x / F.col("w"), DIGITS)).otherwise(0.0)).alias("fused"))


def pair_table(candidates: DataFrame, queries: DataFrame, gallery: DataFrame, branch: str) -> DataFrame:
    """(query_id, slug, features): pair statistics of one branch for training a reranker."""
    q = queries.where(F.col("branch") == branch).select("query_id", F.col("vec").alias("qv"))
    g = gallery.where(F.col("branch") == branch).select("slug", F.col("vec").alias("gv"))
    return candidates.select("query_id", "slug").join(q, "query_id").join(g, "slug").select("query_id", "slug", pair_features(F.col("qv"), F.col("gv")).alias("features"))


def class_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, vec): unit-length element-wise means of unit vectors."""
    cells = vectors.select(F.col(label).alias("label"), F.posexplode("vec").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    rows = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vec"))
    return rows.withColumn("vec", normalized(F.col("vec")))


def class_logits(vectors: DataFrame, centroids: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(id, label, logit): cosine over temperature against every class."""
    left = vectors.select(F.col("id").alias("query_id"), F.lit("class").alias("branch"), "vec")
    left, right = _dealt(left, centroids.select(F.col("label").alias("slug"), F.lit("class").alias("branch"), "vec"), None, None)
    pairs = left.join(right, (F.col("gp") == F.col("g_gp")) & (F.col("qp") == F.col("g_qp")))
    return pairs.select(F.col("query_id").alias("id"), F.col("g_slug").alias("label"), F.round(dot(F.col("vec"), F.col("g_vec")) / F.lit(temperature), 4).alias("logit"))


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): share of the exact rows that were found."""
    hit = exact.join(found.select("query_id", "slug", F.lit(1).alias("hit")), ["query_id", "slug"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))
