"""An inverted-file index over a gallery of vectors: exact top-k without scoring every pair, or approximate top-k of the nearest cells.

Coarse centroids are learnt per branch by k-means whose sums Spark adds up over partitions. The gallery is written in the order of its
cells, every row with its distance to the centroid. A search scores a query's nearest cells first. The last place of what it found and
the triangle inequality then tell which other cells, and which rows of them, could still hold a better row: with d the query's distance to a
centroid and r a row's, their own distance is |d - r| at least. Only those are scored, and the result is ``mining.top_k``'s.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.operators.mining import DIGITS, GALLERY_ROWS, QUERY_ROWS, block_rows, top_k
from catalogmatch.sources.sinks import kept_table, work_dir

#: Queries with a cell to score that a task yields at a time.
SOUGHT_ROWS = 1 << 15
#: Similarities are rounded; what is nearer to a bound than this is scored.
NEAR = 2e-6


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid of each vector, distance to it)."""
    half, step = (centroids**2).sum(axis=1) / 2, block_rows(len(vectors), len(centroids))
    cell = np.concatenate([np.argmax(vectors[at : at + step] @ centroids.T - half, axis=1) for at in range(0, max(1, len(vectors)), step)])
    return cell, np.linalg.norm(vectors - centroids[cell], axis=1)


def _by_branch(frames, sent):
    """(rows of one branch, their vectors as a matrix, the branch's centroids) of each batch."""
    for frame in frames:
        for branch, rows in frame.groupby("branch", sort=False):
            if branch in sent.value:
                yield branch, rows, np.stack(rows["vec"].to_list()).astype(float), sent.value[branch]


def learn_centroids(gallery: DataFrame, cells: int | None = None, fit_rows: int = 200_000, rounds: int = 5) -> dict[str, np.ndarray]:
    """A matrix of centroids for every branch of ``gallery`` (slug, branch, vec).

    Fitted on about ``fit_rows`` rows of a branch at most, chosen by the hash of their slug; ``cells`` is the square root of the branch's
    rows, 4,096 at most, where it is not given. The matrices (a bounded number of rows) are all that comes to the driver.
    """
    sizes = {r.branch: r.n for r in gallery.groupBy("branch").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    every = max(1, -(-max(sizes.values()) // fit_rows))
    sample = kept_table(gallery.where(F.pmod(F.xxhash64("slug"), F.lit(every)) == 0).select("slug", "branch", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "index-fit")
    wanted = {b: cells or min(4096, max(1, math.isqrt(n))) for b, n in sizes.items()}
    first = sample.withColumn("place", F.row_number().over(_hashed())).where(F.col("place") <= max(wanted.values()))
    found = first.orderBy("branch", "place").select("branch", "vec").toPandas()
    centroids = {b: np.stack(rows["vec"].to_list()[: wanted[b]]) for b, rows in found.groupby("branch")}
    for _ in range(rounds):
        sent = sample.sparkSession.sparkContext.broadcast(centroids)

        def sums(frames, sent=sent):
            for branch, _, vectors, near in _by_branch(frames, sent):
                cell = _nearest(vectors, near)[0]
                for c in np.unique(cell).tolist():
                    own = vectors[cell == c]
                    yield pd.DataFrame({"branch": [branch], "cell": [c], "n": [len(own)], "vec": [own.sum(axis=0).tolist()]})

        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        parts = sample.select("branch", "vec").mapInPandas(sums, "branch string, cell int, n long, vec array<double>")
        total = parts.groupBy("branch", "cell").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
        for r in total.toPandas().itertuples():
            centroids[r.branch][r.cell] = np.array(r.vec) / r.n
    return centroids


def _hashed():
    from pyspark.sql import Window

    return Window.partitionBy("branch").orderBy(F.xxhash64("slug"), "slug")


class VectorIndex:
    """An index written at ``path``: rows by cell, and centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        table = spark.read.parquet(f"{self.path}/centroids").orderBy("branch", "cell").toPandas()
        self.centroids = {b: np.stack(rows["vec"].to_list()) for b, rows in table.groupby("branch")} if len(table) else {}
        self.sent = spark.sparkContext.broadcast(self.centroids)
        stats = self.rows.groupBy("branch", "cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most"), F.max("norm").alias("norm"))
        self.cells = {b: rows.set_index("cell").sort_index() for b, rows in stats.toPandas().groupby("branch")}  # a row for each cell

    def _sought(self, queries: DataFrame, k: int, probes: int, query_parts: int, part_rows: int, further: bool) -> DataFrame:
        """Queries with the cells to score: the ``probes`` nearest that are not empty, and more where those hold too few rows; or the others that ``least`` does not rule out."""
        sent = queries.sparkSession.sparkContext.broadcast((self.centroids, self.cells))

        def cells_of(frames):
            all_centroids, all_cells = sent.value
            for frame in frames:
                for branch, rows in frame.groupby("branch", sort=False):
                    if branch in all_cells:
                        stats = all_cells[branch]
                        step = max(1, SOUGHT_ROWS // max(len(stats), int((-(-stats["n"].to_numpy() // part_rows)).sum())))
                        for at in range(0, len(rows), step):
                            yield sought(rows.iloc[at : at + step], stats, all_centroids[branch])

        def sought(rows, stats, near):
            vectors = np.stack(rows["vec"].to_list()).astype(float)
            numbers = stats.index.to_numpy()
            d = np.sqrt(np.maximum(((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ near[numbers].T + (near[numbers] ** 2).sum(axis=1)), 0))
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(stats["n"].to_numpy()[order], axis=1)
            need = k + rows["extra"].to_numpy(int)
            first = np.maximum(probes, (held < need[:, None]).sum(axis=1) + 1)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape).copy(), 1)
            wanted = place < first[:, None]
            if further:
                gap = np.maximum(0, np.maximum(d - stats["most"].to_numpy(), stats["least"].to_numpy() - d) - NEAR)
                most = ((vectors**2).sum(axis=1)[:, None] + stats["norm"].to_numpy() - gap**2) / 2
                wanted = ~wanted & (most >= rows["least"].to_numpy(float)[:, None] - NEAR)
            at, cell = np.nonzero(wanted)
            parts = -(-stats["n"].to_numpy()[cell] // part_rows)
            take, own = np.repeat(at, parts), np.repeat(cell, parts)
            out = rows.iloc[take].copy()
            out["cell"], out["d"], out["parts"] = numbers[own], d[take, own], np.repeat(parts, parts)
            out["part"] = np.arange(len(take)) - np.repeat(np.cumsum(parts) - parts, parts)
            return out[["query_id", "branch", "vec", "extra", "least", "qp", "cell", "part", "parts", "d"]]

        qp = F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("qp")
        rows = queries.select("query_id", "branch", "vec", "extra", "least", qp)
        kind = queries.schema["query_id"].dataType.simpleString()
        return rows.mapInPandas(cells_of, f"query_id {kind}, branch string, vec array<double>, extra int, least double, qp int, cell int, part int, parts int, d double")

    def _scored(self, queries: DataFrame, k: int, probes: int, query_parts: int, part_rows: int, further: bool) -> DataFrame:
        """(query_id, branch, slug, sim, scored): the best rows of every part sought that reach ``least``, and for each part a row without query and slug that says how many pairs were scored."""
        kinds = [queries.schema["query_id"].dataType.simpleString(), self.rows.schema["slug"].dataType.simpleString()]
        left = self._sought(queries, k, probes, query_parts, part_rows, further)
        sizes = queries.sparkSession.createDataFrame([(b, int(c), int(-(-n // part_rows))) for b, stats in self.cells.items() for c, n in stats["n"].items()] or [], "g_branch string, g_cell int, parts int")
        right = self.rows.select(*(F.col(c).alias(f"g_{c}") for c in ("branch", "cell", "slug", "vec", "r", "norm"))).join(F.broadcast(sizes), ["g_branch", "g_cell"])  # a row for each cell
        right = right.withColumn("g_part", F.pmod(F.xxhash64("g_slug"), "parts").cast("int")).drop("parts").withColumn("g_qp", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))

        def best(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            ids, slugs, sims, scored = [], [], [], 0
            if len(q) and len(g):
                g = g.sort_values("g_slug", kind="stable")
                matrix, r, norm, names = np.stack(g["g_vec"].to_list()), g["g_r"].to_numpy(), g["g_norm"].to_numpy(), g["g_slug"].to_numpy(object)
                owners, vectors = q["query_id"].to_numpy(object), np.stack(q["vec"].to_list())
                needs, leasts, ds = k + q["extra"].to_numpy(int), q["least"].to_numpy(float), q["d"].to_numpy(float)
                for owner, vector, need, least, d in zip(owners, vectors, needs, leasts, ds, strict=True):
                    at = np.arange(len(matrix))
                    if further:
                        gap = np.maximum(0, np.abs(d - r) - NEAR)
                        at = np.flatnonzero((vector @ vector + norm - gap**2) / 2 >= least - NEAR)
                    near = np.round(matrix[at] @ vector, DIGITS) + 0.0
                    scored += len(at)
                    at, near = at[near >= least], near[near >= least]  # what is below the last place found cannot take one
                    order = np.argsort(-near, kind="stable")[:need]
                    ids.append(np.full(len(order), owner, object))
                    slugs.append(names[at[order]])
                    sims.append(near[order])
                ids, slugs, sims = ([*np.concatenate(x), None] for x in (ids, slugs, sims))
            columns = {"query_id": ids, "branch": [q["branch"].iloc[0]] * len(ids) if len(q) else [], "slug": slugs, "sim": sims, "scored": [0] * (len(ids) - 1) + [scored] if ids else []}
            frame = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})
            return frame.astype({"sim": float, "scored": "int64"})

        schema = f"query_id {kinds[0]}, branch string, slug {kinds[1]}, sim double, scored long"
        return left.groupBy("branch", "cell", "part", "qp").cogroup(right.groupBy("g_branch", "g_cell", "g_part", "g_qp")).applyInPandas(best, schema)

    def scored(self, queries: DataFrame, k: int = 12, exclude: DataFrame | None = None, probes: int = 4, exact: bool = True, part_rows: int = GALLERY_ROWS) -> DataFrame:
        """The rows of ``top_k`` before the last ranking, and rows without query and slug that count the pairs scored; written."""
        queries = queries.select("query_id", "branch", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
        extra = exclude.groupBy("query_id").agg(F.count("*").cast("int").alias("extra")) if exclude is not None else None
        queries = queries.join(extra, "query_id", "left") if extra is not None else queries.withColumn("extra", F.lit(0))
        queries = kept_table(queries.withColumns({"extra": F.coalesce("extra", F.lit(0)), "least": F.lit(-math.inf)}), "index-queries")
        parts = max(1, -(-queries.count() // QUERY_ROWS))
        drop = lambda rows: rows.join(exclude, ["query_id", "slug"], "left_anti") if exclude is not None else rows
        found = kept_table(drop(self._scored(queries, k, probes, parts, part_rows, False)), "index-first")
        if not exact:
            return found
        last = top_k(found.where("slug IS NOT NULL"), k).where(F.col("branch_rank") == k).select("query_id", "branch", F.col("sim").alias("least"))
        queries = queries.drop("least").join(last, ["query_id", "branch"], "left").withColumn("least", F.coalesce("least", F.lit(-math.inf)))
        return kept_table(found.unionByName(drop(self._scored(queries, k, probes, parts, part_rows, True))), "index-found")

    def top_k(self, queries: DataFrame, k: int = 12, exclude: DataFrame | None = None, probes: int = 4, exact: bool = True) -> DataFrame:
        """(query_id, branch, slug, sim, branch_rank): ``mining.top_k`` over all pairs; without ``exact`` over each query's ``probes`` nearest cells."""
        return top_k(self.scored(queries, k, exclude, probes, exact).where("slug IS NOT NULL").drop("scored"), k)

    def probes_for(self, queries: DataFrame, k: int = 12, recall: float = 0.9, exclude: DataFrame | None = None, most_queries: int = 200) -> dict[str, int]:
        """For every branch the least number of nearest cells that hold a share ``recall`` of the true ``k`` best of a sample of queries.

        The sample is the ``most_queries`` ids of smallest hash, searched exactly; what comes to the driver is bounded by it.
        """
        ids = queries.select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(most_queries)
        sample = kept_table(queries.join(F.broadcast(ids), "query_id", "left_semi").select("query_id", "branch", "vec"), "index-sample")
        true = self.top_k(sample, k, exclude).join(self.rows.select("branch", "slug", "cell"), ["branch", "slug"])
        held = true.groupBy("query_id", "branch").agg(F.collect_list("cell").alias("cells")).join(sample, ["query_id", "branch"])  # k cells a query
        out = {}
        for branch, rows in held.toPandas().groupby("branch"):
            numbers, near = self.cells[branch].index.to_numpy(), self.centroids[branch]
            places = []
            for cells, vector in zip(rows["cells"], rows["vec"], strict=True):
                order = numbers[np.argsort(np.linalg.norm(near[numbers] - np.asarray(vector, float), axis=1), kind="stable")].tolist()
                places += [order.index(c) + 1 for c in cells]
            out[branch] = int(np.sort(places)[max(0, math.ceil(recall * len(places)) - 1)])
        return out

    def append(self, gallery: DataFrame) -> VectorIndex:
        """The index with more rows; centroids stay, and cells and bounds follow the rows."""
        _assigned(gallery, self.sent).write.mode("append").parquet(f"{self.path}/rows")
        return VectorIndex(gallery.sparkSession, self.path)


def _assigned(gallery: DataFrame, sent) -> DataFrame:
    """``gallery`` with cell, distance to the centroid and squared norm, in the order of cells."""
    kind = gallery.schema["slug"].dataType.simpleString()

    def assign(frames):
        for _, rows, vectors, near in _by_branch(frames, sent):
            cell, r = _nearest(vectors, near)
            yield pd.DataFrame({"slug": rows["slug"], "branch": rows["branch"], "vec": rows["vec"], "cell": cell, "r": r, "norm": (vectors**2).sum(axis=1)})

    rows = gallery.where("vec IS NOT NULL").select("slug", "branch", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    rows = rows.mapInPandas(assign, f"slug {kind}, branch string, vec array<double>, cell int, r double, norm double")
    return rows.repartitionByRange("branch", "cell", "r").sortWithinPartitions("branch", "cell", "r")


def build_index(gallery: DataFrame, path: str | None = None, cells: int | None = None, fit_rows: int = 200_000, rounds: int = 5) -> VectorIndex:
    """Learns centroids, and writes every row of ``gallery`` (slug, branch, vec) to ``path`` (a new folder of the shared one, if none is named).

    Rows with a null vector are in no branch's index.
    """
    spark = gallery.sparkSession
    gallery = gallery.where("vec IS NOT NULL")
    path = (path or work_dir(spark, "index")).rstrip("/")
    centroids = learn_centroids(gallery, cells, fit_rows, rounds)
    rows = [(b, k, row.tolist()) for b, matrix in centroids.items() for k, row in enumerate(matrix)]
    spark.createDataFrame(rows, "branch string, cell int, vec array<double>").write.parquet(f"{path}/centroids")
    _assigned(gallery, spark.sparkContext.broadcast(centroids)).write.parquet(f"{path}/rows")
    return VectorIndex(spark, path)


def index_work(scored: DataFrame, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(branch, n_pairs, n_scored, share): how many of all pairs a search (``VectorIndex.scored``) has scored."""
    pairs = queries.groupBy("branch").agg(F.count("*").alias("q")).join(gallery.groupBy("branch").agg(F.count("*").alias("g")), "branch")
    done = scored.groupBy("branch").agg(F.sum("scored").alias("n_scored"))
    return pairs.join(done, "branch").select("branch", (F.col("q") * F.col("g")).alias("n_pairs"), "n_scored", F.round(F.col("n_scored") / (F.col("q") * F.col("g")), 6).alias("share"))


def approximate_top_k(queries: DataFrame, gallery: DataFrame, branch: str, k: int = 12, recall: float = 0.9, index: VectorIndex | None = None) -> DataFrame:
    """``top_k`` of one branch over each query's nearest cells, as many as a sample of the queries needs for ``recall`` (see ``recall_against``)."""
    queries = queries.where(F.col("branch") == branch)
    index = index or build_index(gallery.where(F.col("branch") == branch))
    return index.top_k(queries, k, probes=index.probes_for(queries, k, recall).get(branch, 1), exact=False)
