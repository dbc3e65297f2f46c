"""Quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a vector of statistics (lengths, character classes, repetition). Standardised, the vector is mapped by
random Fourier features, whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal
equations, Spark adds the parts up, and the driver solves one small system. Raw ridge scores become probabilities by
isotonic regression on training rows that the ridge fit has not seen.

Results in special cases: null and empty texts score as the vector of an empty text; repeated rows score alike; an empty
table gives an empty result; where the training rows lack one of the classes, every score is the share of label 1 among
them (1 without any, so that nothing is rejected unlearnt).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import digest, labelled_sample, map_batches, scored, table, written

N_STATS = 19
BLOCK = 1 << 20
#: Character classes: 0 letter and all beyond ASCII, 1 capital, 2 digit, 3 sentence mark, 4 white space, 5 pipe, 6 other symbol, 7 exclamation mark.
_CLASS = np.zeros(128, np.uint8)
_CLASS[:] = 6
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3
_CLASS[[*range(9, 14), 32]] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 7


def text_statistics(text: str) -> list[float]:
    """The ``N_STATS`` statistics of one whole text."""
    counts = np.zeros(8, np.int64)
    for start in range(0, len(text), BLOCK):
        points = np.frombuffer(text[start : start + BLOCK].encode("utf-32-le", "replace"), np.uint32)
        counts += np.bincount(np.where(points < 128, _CLASS[np.minimum(points, 127)], 0), minlength=8)
    n = max(1, int(counts.sum()))
    words = text.split()
    n_words = max(1, len(words))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    upper = sum(map(str.isupper, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(1 for x in lines if x.rstrip()[-1] in ".!?")
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        (n - counts[4]) / n_words,
        *(counts[k] / n for k in range(8)),
        len(distinct) / n_words,
        len({x.lower() for x in distinct}) / n_words,
        pairs / max(1, len(words) - 1),
        len(set(lines)) / n_lines,
        np.log1p(n_words / n_lines),
        upper / n_words,
        ends / n_lines,
        (counts[5] + counts[6] + counts[7]) / n_words,
    ]


@dataclass
class QualityModel:
    """Everything that scores a text: scaling, Fourier frequencies and phases, ridge weights, isotonic steps."""

    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, *self.steps), 0, 1)

    def score_texts(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return self.calibrated(self.raw(np.array([text_statistics(x) for x in texts])))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row."""
        return scored(docs, self.score_texts, id_col, text_col)

    def keep(self, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
        import pyarrow as pa

        def passing(batches):
            for batch in batches:
                scores = self.score_texts([x or "" for x in batch.column(text_col).to_pylist()])
                yield batch.filter(pa.array(scores >= threshold))

        return map_batches(docs, passing, docs.schema)


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of ``labels`` on ``raw`` (pool adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first raw, last raw
    for x, y in zip(raw[order], labels[order], strict=True):
        blocks.append([y, 1.0, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2], last]
    knots = [(x, b[0] / b[1]) for b in blocks for x in dict.fromkeys(b[2:])]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """(features' features, features' labels), summed within partitions and then by Spark."""
    import pyarrow as pa

    size = len(model.phases) + 1
    upper = np.triu_indices(size)

    def part(batches):
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.features(batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1))
                gram += z.T @ z
                right += z.T @ batch.column("label").to_numpy()
        cells = [np.append(upper[0], np.arange(size)), np.append(upper[1], np.full(size, -1)), np.append(gram[upper], right)]
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int32()), pa.array(cells[2])], ["i", "j", "v"])

    cells = map_batches(rows.select("stats", "label"), part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells[c].to_numpy() for c in ("i", "j", "v"))
    gram, right = np.zeros((size, size)), np.zeros(size)
    right[i[j < 0]] = v[j < 0]
    i, j, v = i[j >= 0], j[j >= 0], v[j >= 0]
    gram[i, j] = v
    gram[j, i] = v
    return gram, right


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_rows: int = 40_000,
    n_features: int = 192,
    width: float = 4.0,
    ridge: float = 1e-3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, chosen by hashed id.

    A quarter of them calibrates. ``width`` is the Gaussian kernel's. The driver receives the
    ``n_features`` x ``n_features`` sums and the calibration rows' scores.
    """
    import pyarrow as pa

    sample = labelled_sample(docs, labels, label_col, max_rows, id_col, text_col)

    def measure(batches):
        for batch in batches:
            stats = [text_statistics(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("part"), pa.array(stats, pa.list_(pa.float64()))], ["label", "part", "stats"])

    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4)).cast("int")
    rows = written(map_batches(sample.select("label", part.alias("part"), "text"), measure, "label int, part int, stats array<double>"), "quality-stats")
    at = [F.element_at("stats", k + 1) for k in range(N_STATS)]
    sums = rows.agg(F.count("*"), F.sum("label"), *(f(x) for x in at for f in (F.avg, F.stddev_pop))).first()
    none = np.zeros(0)
    if not sums[0] or sums[1] in (0, sums[0]):
        return QualityModel(none, none, none, none, none, constant=sums[1] / sums[0] if sums[0] else 1.0)
    made = np.random.default_rng(seed)
    spread = np.array(sums[3::2], float)
    model = QualityModel(
        np.array(sums[2::2], float),
        np.where(spread > 1e-9, spread, 1.0),
        made.normal(0, 1 / width, (N_STATS, n_features)),
        made.uniform(0, 2 * np.pi, n_features),
        none,
    )
    fit_rows, calibration = rows.where("part > 0"), rows.where("part = 0")
    gram, right = _normal_equations(fit_rows, model)
    model.weights = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) * np.eye(len(gram)), right)
    seen = calibration.select("label", "stats").toArrow()
    if not len(seen):
        seen = rows.select("label", "stats").limit(max_rows).toArrow()
    stats = seen["stats"].combine_chunks().flatten().to_numpy().reshape(len(seen), -1)
    model.steps = isotonic(model.raw(stats), seen["label"].to_numpy().astype(float))
    return model


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = table(spark, sf_dir, "documents")
    return digest(fit_quality(docs, table(spark, sf_dir, "labels")).score(docs), 0.3)
