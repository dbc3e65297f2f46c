"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Every text becomes the set of its hashed character n-grams. Over the training rows Spark counts, per bucket, the toxic
and the other texts that hold it; the ratio of the two smoothed shares is the bucket's log-count ratio. Buckets whose
ratio stands out from chance are the features, their value is that ratio, and a logistic regression weighs them. Its
gradients are sums over partitions, so the number of features needs no cap.

Results in special cases: null and empty texts score as texts without features; repeated rows score alike; an empty
table gives an empty result; where the training rows lack one of the classes, every score is the share of label 1 among
them (0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from catalogmatch.llm.common import digest, labelled_sample, map_batches, scored, table, written

SIZES = (3, 4, 5)
BITS = 21
BLOCK = 1 << 20
#: Rows whose features a worker holds at a time.
ROWS = 128


def gram_buckets(text: str, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams of the lower-cased, space-folded and space-padded text; only those in ``keep``."""
    folded = f" {' '.join(text.lower().split())} "
    points = np.frombuffer(folded.encode("utf-32-le", "replace"), np.uint32)
    found = []
    for start in range(0, max(1, len(points) - 1), BLOCK):
        part = points[start : start + BLOCK + SIZES[-1] - 1]
        rolled = part
        for n in range(2, SIZES[-1] + 1):
            rolled = rolled[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in SIZES:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
                buckets = mixed >> np.uint32(32 - BITS)
                found.append(buckets if keep is None else buckets[keep[buckets]])
    return np.unique(np.concatenate(found))


@dataclass
class ToxicityModel:
    """``buckets`` (sorted) with their ``weights``, and a ``bias``; ``constant`` replaces them where nothing could be fitted."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def score_texts(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        keep = np.zeros(1 << BITS, bool)
        keep[self.buckets] = True
        raw = np.empty(len(texts))
        for k, text in enumerate(texts):
            raw[k] = self.weights[np.searchsorted(self.buckets, gram_buckets(text, keep))].sum()
        return 1 / (1 + np.exp(-np.clip(raw + self.bias, -40, 40)))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row."""
        return scored(docs, self.score_texts, id_col, text_col)


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, other): how many texts of either label hold it; bucket -1 counts the texts."""
    import pyarrow as pa

    def count(batches):
        counts = np.zeros((2, 1 << BITS), np.int32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label][gram_buckets(text)] += 1
                texts[label] += 1
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1), pa.int64()), *(pa.array(np.append(counts[k][found], texts[k]), pa.int64()) for k in (1, 0))],
            ["bucket", "toxic", "other"],
        )

    partial = map_batches(sample.select("text", "label"), count, "bucket long, toxic long, other long")
    return partial.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _weights(rows: DataFrame, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias) by Spark ML; every step adds up the partitions' gradients, the driver holds weights only."""
    fitted = LogisticRegression(maxIter=steps, regParam=ridge, standardization=False, tol=1e-7).fit(rows)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    max_rows: int = 30_000,
    least_z: float = 2.5,
    ridge: float = 1e-4,
    steps: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, chosen by hashed id.

    Every bucket whose log-count ratio has a z-score of ``least_z`` or more becomes a feature. The driver receives these
    (at most 2 ** ``BITS``) and a weight for each; the training rows stay on the executors.
    """
    import pyarrow as pa

    sample = written(labelled_sample(docs, labels, label_col, max_rows, id_col, text_col), "toxic-sample")
    counts = written(_gram_counts(sample), "toxic-counts")
    toxic, other = counts.where("bucket = -1").agg(F.sum("toxic"), F.sum("other")).first()
    if not toxic or not other:
        return ToxicityModel(np.zeros(0, int), np.zeros(0), 0.0, constant=float(bool(toxic)))
    ratio = F.log((F.col("toxic") + 1) / F.lit(toxic + 2)) - F.log((F.col("other") + 1) / F.lit(other + 2))
    spread = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("other") + 1))
    told = counts.where("bucket >= 0").select("bucket", ratio.alias("ratio"), F.abs(ratio / spread).alias("z")).where(F.col("z") >= least_z)
    features = told.select("bucket", "ratio").toArrow()
    order = np.argsort(features["bucket"].to_numpy())
    buckets, ratios = features["bucket"].to_numpy()[order], features["ratio"].to_numpy()[order]
    if not len(buckets):
        return ToxicityModel(np.zeros(0, int), np.zeros(0), 0.0, constant=toxic / (toxic + other))
    sent = docs.sparkSession.sparkContext.broadcast((buckets, ratios))

    def vectors(batches):
        buckets, ratios = sent.value
        keep = np.zeros(1 << BITS, bool)
        keep[buckets] = True
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            held = [np.searchsorted(buckets, gram_buckets(x, keep)).astype(np.int32) for x in batch.column("text").to_pylist()]
            n = len(held)
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(buckets), np.int32)), pa.array(held, pa.list_(pa.int32())), pa.array([ratios[x] for x in held], pa.list_(pa.float64()))]
            features = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), features], ["label", "features"])

    rows = map_batches(sample.select("label", "text"), vectors, "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    sparse = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    weights, bias = _weights(written(rows, "toxic-vectors", sparse), ridge, steps)
    return ToxicityModel(buckets, weights * ratios, bias)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = table(spark, sf_dir, "documents")
    return digest(fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs), 0.5)
