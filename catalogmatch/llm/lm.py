"""Masked pseudo-likelihood: every word is predicted from the words on both sides of it.

A count over all documents gives the corpus's word table. Its ``n_words`` most frequent words are units of their own; all
other words fall into tail units by their last two bytes. A network with one hidden layer reads the units of two words on
either side (an embedding for each unit and side) and predicts the unit in between, as a class of units and then a unit of
that class. It is trained in numpy: every partition takes the positions of its own texts, each position once in all
rounds, and a round ends by averaging the partitions' parameters, weighted by positions. A word of a tail unit is
predicted within the unit by its count in the rest of the corpus, the text's own occurrences masked; these counts are a
Spark table that grows with the corpus and is joined to the texts' words. A text's score is the sum over all its words of
log P(unit | both sides) + log P(word | unit).

The trained network depends on the order of rows and on how they are dealt to trainers, in the last digits of a score or, on small
inputs, more; what it gains from the words around does not depend on the number of partitions.

Results in special cases: null and empty texts have no words, a sum of 0 and no mean; rows that repeat a text score alike
(but for the last digits); rows without an id are scored like others; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import _IS_SPACE, _LOWER, group_words, groups_of, map_batches, table, written

SIDES = (-2, -1, 1, 2)
BATCH = 16384
WIDTH = 64
#: Tail units; a word's is chosen by its last two bytes.
TAILS = 512
#: Added to the count of every tail word.
PRIOR = 0.1
#: Positions that a trainer has at least, in all rounds, where the input has so many.
POSITIONS = 2_000_000
#: A model travels in so many pieces, and so many partitions' models are added up in one task.
PIECES, FAN = 16, 64


def endings(texts: list[bytes]) -> np.ndarray:
    """A number below ``TAILS`` for each word of the texts, from its last two bytes."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    last = np.flatnonzero(_IS_SPACE[raw[1:]] & ~_IS_SPACE[raw[:-1]])
    one, two = (_LOWER[raw[at]].astype(np.uint32) for at in (last - 1, last))
    return ((one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA6B)) >> np.uint32(23)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, ending, n) of every word of all texts; partitions count their batches' words first."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = []
            for group in groups_of([x or b"" for x in batch.column(0).cast(pa.large_binary()).to_pylist()]):
                words, ends = group_words(group)[0], endings(group)
                hashes, first, n = np.unique(words, return_index=True, return_counts=True)
                found.append((hashes, ends[first], n))
            if found:
                hashes, ends, n = (np.concatenate(x) for x in zip(*found, strict=True))
                hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                n = np.bincount(inverse, n, len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ends[first].astype(np.int32)), pa.array(n)], ["hash", "ending", "n"])

    return map_batches(docs.select(text_col), run, "hash long, ending int, n long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words (sorted ``hashes`` and their ``units``), every unit's count, and log(count + prior) of the words of each tail unit."""

    hashes: np.ndarray
    units: np.ndarray
    counts: np.ndarray
    tail_logs: np.ndarray

    def encode(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit of each word, whether the unit is a tail)."""
        if not len(self.hashes):
            return len(self.counts) - TAILS + ends, np.ones(len(words), bool)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        known = self.hashes[at] == words
        return np.where(known, self.units[at], len(self.counts) - TAILS + ends), ~known


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities over rows, in place; logits beyond 60 count as 60."""
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], np.float32)
    logits *= (1 / sums)[:, None]
    return logits


def vocabulary(counts: DataFrame, n_words: int) -> Vocabulary:
    """Of the table of counts, the driver receives the ``n_words`` most frequent words and a row per tail unit."""
    top = counts.orderBy(F.desc("n"), "hash").limit(n_words).select("hash", "n")
    frequent = top.toArrow()
    hashes, n = frequent["hash"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    known = counts.sparkSession.createDataFrame(frequent).select("hash")
    tails = counts.join(F.broadcast(known), "hash", "left_anti").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    sums = np.zeros(n_words + TAILS)
    sums[: len(n)] = n
    sums[n_words + tails["ending"].to_numpy()] = tails["n"].to_numpy()
    logs = np.zeros(TAILS)
    logs[tails["ending"].to_numpy()] = np.log(tails["n"].to_numpy() + PRIOR * tails["words"].to_numpy())
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, sums, logs)


def encoded(docs: DataFrame, known: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, units, tails, times, row) of every row: two bytes for each word, the distinct words of tail units and how often each occurs."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            units, tails, times = [], [], []
            for group in groups_of([x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]):
                words, bounds = group_words(group)
                unit, tail = known.encode(words, endings(group))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    units.append(unit[a:b].astype("<u2").tobytes())
                    hashes, n = np.unique(words[a:b][tail[a:b]], return_counts=True)
                    tails.append(hashes.view(np.int64))
                    times.append(n.astype(np.int32))
            columns = [batch.column(0), pa.array(units, pa.binary()), pa.array(tails, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "units", "tails", "times"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {id_type}, units binary, tails array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id())


def _joined(column) -> tuple[np.ndarray, np.ndarray]:
    """(units of all texts, one after another; bounds of the texts)."""
    parts = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, "<u2")).astype(np.int32), np.cumsum([0, *map(len, parts)])


class WindowModel:
    """``layers``: an embedding table per side, hidden bias, class weights and biases, unit weights and biases by class.

    Units are numbered so that class c holds the units from c * WIDTH on; one more row of the tables is the edge of a text.
    """

    def __init__(self, layers: list[np.ndarray], seen: list[np.ndarray] | None = None):
        self.layers = layers
        self.seen = seen or [np.full(x.shape[:-1], 1e-6, np.float32) for x in layers]

    @classmethod
    def begin(cls, counts: np.ndarray, hidden: int, seed: int) -> WindowModel:
        """Embeddings at random, outputs at the units' shares."""
        made, n = np.random.default_rng(seed), len(counts)
        mass = (counts + 1.0).reshape(-1, WIDTH)
        of_class = np.log(mass.sum(axis=1) / mass.sum())
        of_unit = np.log(mass / mass.sum(axis=1, keepdims=True))
        tables = [made.normal(0, 0.3, (n + 1, hidden)) for _ in SIDES]
        outputs = [np.zeros((n // WIDTH, hidden)), of_class, np.zeros((n // WIDTH, WIDTH, hidden)), of_unit]
        return cls([x.astype(np.float32) for x in [*tables, np.zeros(hidden), *outputs]])

    @property
    def n_units(self) -> int:
        return len(self.layers[0]) - 1

    def padded(self, units: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units with two edges before, between and after the texts; place of each word in them)."""
        place = np.arange(len(units), dtype=np.int32) + np.repeat(np.arange(2, 2 * len(bounds), 2, dtype=np.int32), np.diff(bounds))
        out = np.full(len(units) + 2 * len(bounds), self.n_units, np.int32)
        out[place] = units
        return out, place

    def hidden(self, sides: list[np.ndarray]) -> np.ndarray:
        first, *rest = (np.take(t, s, axis=0) for t, s in zip(self.layers, sides, strict=False))
        for more in rest:
            first += more
        first += self.layers[len(SIDES)]
        return np.tanh(first, out=first)

    def _paced(self, k: int, rows, gradient: np.ndarray, rate: float) -> None:
        """A step on ``rows`` of a layer, slower the more has been done to a row (Adagrad by rows)."""
        done = self.seen[k][rows] + np.einsum("...i,...i->...", gradient, gradient) / gradient.shape[-1]
        self.seen[k][rows] = done
        self.layers[k][rows] -= gradient * (rate / np.sqrt(done))[..., None]

    def step(self, sides: list[np.ndarray], own: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch of positions."""
        order = np.argsort(own.astype(np.uint16), kind="stable")
        own, sides = own[order], [s[order] for s in sides]
        hidden = self.hidden(sides)
        bias, classes, class_bias, units, unit_bias = range(len(SIDES), len(self.layers))
        of_class, within = own // WIDTH, own % WIDTH
        wrong = softmax(hidden @ self.layers[classes].T + self.layers[class_bias])
        wrong[np.arange(len(own)), of_class] -= 1
        back = wrong @ self.layers[classes]
        to_classes, to_class_bias = wrong.T @ hidden, wrong.sum(axis=0)
        cuts = np.searchsorted(of_class, np.arange(len(self.layers[classes]) + 1)).tolist()
        for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                wrong = softmax(hidden[a:b] @ self.layers[units][c].T + self.layers[unit_bias][c])
                wrong[np.arange(b - a), within[a:b]] -= 1
                back[a:b] += wrong @ self.layers[units][c]
                self._paced(units, c, wrong.T @ hidden[a:b] / len(own), rate)
                self.layers[unit_bias][c] -= rate * wrong.sum(axis=0) / len(own)
        self._paced(classes, slice(None), to_classes / len(own), rate)
        self.layers[class_bias] -= rate * to_class_bias / len(own)
        hidden *= hidden
        back *= 1 - hidden
        back /= len(own)
        self.layers[bias] -= rate * back.sum(axis=0)
        columns = np.ascontiguousarray(back.T)
        for k, side in enumerate(sides):
            rows = np.flatnonzero(np.bincount(side, minlength=len(self.layers[k])))
            sums = np.array([np.bincount(side, x, len(self.layers[k])).astype(np.float32)[rows] for x in columns])
            self._paced(k, rows, sums.T, rate)

    def flat(self) -> np.ndarray:
        """All that is trained, in one array."""
        return np.concatenate([x.ravel() for x in [*self.layers, *self.seen]])

    def refilled(self, flat: np.ndarray) -> WindowModel:
        """A model of the same shapes from such an array."""
        sizes = [x.size for x in [*self.layers, *self.seen]]
        parts = [p.astype(np.float32).reshape(x.shape) for p, x in zip(np.split(flat, np.cumsum(sizes)[:-1]), [*self.layers, *self.seen], strict=True)]
        return WindowModel(parts[: len(self.layers)], parts[len(self.layers) :])

    def train(self, units: np.ndarray, bounds: np.ndarray, turn: int, turns: int, rate: float, batch: int = BATCH) -> int:
        """Steps on every position of the joined texts that is ``turn`` modulo ``turns``; their number."""
        padded, place = self.padded(units, bounds)
        chosen = place[turn::turns]
        for k in range(0, len(chosen), batch):
            at = chosen[k : k + batch]
            self.step([padded[at + d] for d in SIDES], padded[at], rate * min(1.0, len(at) / 512))
        return len(chosen)

    def position_sums(self, sides: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """log P(unit | both sides) of each position."""
        order = np.argsort(own.astype(np.uint16), kind="stable")
        own = own[order]
        hidden = self.hidden([s[order] for s in sides])
        *_, classes, class_bias, units, unit_bias = self.layers
        of_class, within = own // WIDTH, own % WIDTH

        def told(logits, which):
            return np.log(np.maximum(softmax(logits)[np.arange(len(which)), which], 1e-37))

        found = told(hidden @ classes.T + class_bias, of_class)
        cuts = np.searchsorted(of_class, np.arange(len(classes) + 1)).tolist()
        for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                found[a:b] += told(hidden[a:b] @ units[c].T + unit_bias[c], within[a:b])
        out = np.empty(len(own), np.float32)
        out[order] = found
        return out

    def text_sums(self, units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The summed log P(unit | both sides) of each text."""
        padded, place = self.padded(units, bounds)
        each = np.zeros(len(units))
        for start in range(0, len(units), BATCH):
            at = place[start : start + BATCH]
            each[start : start + BATCH] = self.position_sums([padded[at + d] for d in SIDES], padded[at])
        sums = np.concatenate([[0.0], np.cumsum(each)])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _averaged(trained: DataFrame, parts: int) -> np.ndarray | None:
    """The mean of the partitions' models (part, piece, weight, floats), by weight; levels of means keep every group small."""
    import pyarrow as pa

    def added(rows: pa.Table) -> pa.Table:
        weights = rows["weight"].to_numpy()
        mean = sum(np.frombuffer(x, np.float32) * w for x, w in zip(rows["floats"].to_pylist(), weights / weights.sum(), strict=True))
        columns = [rows["part"][:1].combine_chunks(), rows["piece"][:1].combine_chunks(), pa.array([weights.sum()]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())]
        return pa.table(columns, ["part", "piece", "weight", "floats"])

    schema = "part int, piece int, weight double, floats binary"
    while parts > 1:
        parts = -(-parts // FAN)
        trained = trained.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part", "piece").applyInArrow(added, schema)
    rows = sorted(trained.collect(), key=lambda r: r.piece)  # PIECES rows
    return np.concatenate([np.frombuffer(r.floats, np.float32) for r in rows]) if rows else None


def fit_window_model(words: DataFrame, counts: np.ndarray, hidden: int = 32, rounds: int = 4, rate: float = 0.3, seed: int = 5) -> WindowModel:
    """Trains on (units) of all rows; round ``r`` takes the positions of a batch that are r modulo ``rounds``, so that each counts once.

    A trainer has ``POSITIONS`` positions at least: partitions with less are read together, so that what is learnt between two
    averages does not depend on how many partitions there are. Larger inputs have as many trainers as partitions.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    model = WindowModel.begin(counts, hidden, seed)
    context, parts = words.sparkSession.sparkContext, words.select("units").rdd.getNumPartitions()
    parts = max(1, min(parts, int(counts.sum() // POSITIONS)))
    words = words.select("units").coalesce(parts)
    steps = int(np.clip(counts.sum() / parts / 128, 512, BATCH))  # positions of a step; small inputs take smaller ones
    for turn in range(rounds):
        sent = context.broadcast((model.layers, model.seen))

        def train(batches, turn=turn, sent=sent):
            layers, seen = sent.value
            own, weight = WindowModel([x.copy() for x in layers], [x.copy() for x in seen]), 0
            for batch in batches:
                weight += own.train(*_joined(batch.column(0)), turn, rounds, rate, steps)
            if weight:
                pieces = np.array_split(own.flat(), PIECES)
                part = TaskContext.get().partitionId()
                columns = [pa.array(np.full(PIECES, part, np.int32)), pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, float(weight)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in pieces], pa.binary())], ["part", "piece", "weight", "floats"])

        flat = _averaged(map_batches(words, train, "part int, piece int, weight double, floats binary"), parts)
        if flat is None:
            break
        model = model.refilled(flat)
    return model


def score_words(words: DataFrame, model: WindowModel, known: Vocabulary, counts: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row of ``encoded``."""
    import pyarrow as pa

    id_type = words.schema["doc_id"].dataType.simpleString()
    sent = words.sparkSession.sparkContext.broadcast((model.layers, np.concatenate([np.zeros(len(known.counts) - TAILS), known.tail_logs])))

    def run(batches):
        layers, logs = sent.value
        own = WindowModel(layers)
        for batch in batches:
            units, bounds = _joined(batch.column(2))
            within = np.concatenate([[0.0], np.cumsum(logs[units])])
            sums = own.text_sums(units, bounds) - (within[bounds[1:]] - within[bounds[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(sums)], ["row", "doc_id", "n_words", "sum"])

    network = map_batches(words.select("row", "doc_id", "units"), run, f"row long, doc_id {id_type}, n_words long, sum double")
    tails = words.select("row", F.inline(F.arrays_zip("tails", "times"))).withColumnRenamed("tails", "hash")
    #: No word of a tail unit is frequent, so no key of this join is hot.
    rest = tails.join(counts.select("hash", "n"), "hash").select("row", (F.col("times") * F.log(F.col("n") - F.col("times") + F.lit(PRIOR))).alias("v"))
    rest = rest.groupBy("row").agg(F.sum("v").alias("rest"))
    total = F.col("sum") + F.coalesce("rest", F.lit(0.0))
    return network.join(rest, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood")
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 56 * WIDTH) -> DataFrame:
    """Trains on the documents and scores each of them. ``n_words`` is how many words are units of the network, a multiple of ``WIDTH``."""
    counts = written(word_counts(docs, text_col), "lm-counts")
    known = vocabulary(counts, n_words)
    words = written(encoded(docs, known, id_col, text_col), "lm-words")
    return score_words(words, fit_window_model(words, known.counts), known, counts)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihoods of every document."""
    return score_documents(table(spark, sf_dir, "documents"))
