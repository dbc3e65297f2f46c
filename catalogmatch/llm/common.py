"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words, and what the exact-copy rule folds into one space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, tag: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back (as ``schema``): cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


#: Bytes of an Arrow batch: what a Python worker holds at a time besides its own tables.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about ``BATCH_BYTES``, so that long texts do not pile up in the workers.

    The size is a setting of the session, read when the plan runs, so it stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5, and for rows without an id: never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def clean_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): one row per labelled id that may be learnt from; ids with contradicting labels are left out."""
    label = F.col(label_col).cast("int")
    return (
        labels.select(F.col(id_col).alias("doc_id"), label.alias("label"))
        .where(F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled ids, those whose hashed ids are smallest.

    The chosen labels (16 bytes each, ``max_rows`` of them) are broadcast, so only chosen texts are shuffled. Of several
    texts of an id the smallest counts.
    """
    chosen = clean_labels(labels, label_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def scored(docs: DataFrame, score_texts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: ``score_texts`` maps a list of texts (null: "") to their scores."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(texts), pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), score, f"doc_id {id_type}, score double")


def digest(scores: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) from (doc_id, score)."""
    return scores.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def sized(table_: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``most_rows``; else as it is, to be shuffled."""
    return F.broadcast(table_) if table_.count() <= most_rows else table_


def grouped_join(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, most_groups: int = 1000) -> DataFrame:
    """``rows`` left-joined on ``keys`` with ``groups``, a written table that counts each group's rows in ``size_col``.

    Groups of more than one row in ``most_groups`` are fewer than that: they are broadcast and their rows never shuffled, so
    no key that is dealt to a task holds more.
    """
    total = groups.agg(F.sum(size_col)).first()[0] or 0
    large = F.broadcast(groups.where(F.col(size_col) * most_groups > total))
    others = rows.join(large.select(*keys), keys, "left_anti")
    return rows.join(large, keys).unionByName(others.join(sized(groups.where(F.col(size_col) * most_groups <= total)), keys, "left"))


def hub_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", most_keys: int = 1000) -> DataFrame:
    """``rows`` (written) joined with ``one``, which has a narrow row per ``key`` at most.

    Keys of more than one row in ``most_keys`` are fewer than that: their rows of ``one`` are broadcast, the others shuffled.
    """
    total = rows.count()
    hot = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * most_keys > total).select(key), "hot-keys")
    hot = F.broadcast(hot)
    near = rows.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key, how)
    return near.unionByName(rows.join(hot, key, "left_anti").join(one, key, how))


def salted_join(rows: DataFrame, one: DataFrame, key: str, spread: str, most_keys: int = 1000) -> DataFrame:
    """``rows`` (written) joined with ``one``, which has a row of any width per ``key`` at most.

    The rows of a key that holds more than one in ``most_keys`` are dealt by ``spread`` into parts of that size, each of
    which meets a copy of the key's row; all keys together have fewer than ``most_keys`` more copies than rows.
    """
    part = max(64, rows.count() // most_keys)
    salts = written(rows.groupBy(key).agg(F.ceil(F.count("*") / part).cast("int").alias("salts")).where("salts > 1"), "salts")
    salts = F.broadcast(salts)  # fewer than most_keys rows
    n = F.coalesce("salts", F.lit(1))
    dealt = rows.join(salts, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), n).cast("int")).drop("salts")
    copies = one.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    return dealt.join(copies, [key, "salt"]).drop("salt")


# Words and shingles of a text as 64-bit numbers


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64; kept."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            _POWERS[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16) - 1, base, np.uint64))])
    return _POWERS


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = 1 << 18


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit number for each word of a UTF-8 text, A-Z in lower case; equal words have equal numbers."""
    out, start = [], 0
    while start < len(data):
        stop = min(len(data), start + _PART)
        if stop < len(data):  # cut at a space
            cut = max(data.rfind(s, start, stop) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            stop = cut if cut > start else min([len(data), *(x for x in (data.find(s, stop) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0)])
        raw = np.frombuffer(data, np.uint8, stop - start, start)
        space = np.concatenate([[True], _IS_SPACE[raw], [True]])
        turns = np.flatnonzero(space[1:] != space[:-1])
        first, last = turns[::2], turns[1::2]
        ahead, back = (p[: len(raw) + 1] for p in _powers(len(raw) + 1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * ahead[:-1])])
        out.append(mixed((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)))
        start = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(data: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct numbers of the n-word shingles; of fewer words the whole sequence; none without words."""
    words = word_hashes(data)
    if not len(words):
        return words
    k = min(n, len(words))
    rolled = words[: len(words) - k + 1] + np.uint64(k)
    for j in range(1, k):
        rolled = mixed(rolled * _STEP + words[j : len(words) - k + 1 + j])
    return np.unique(rolled)


def batch_shingles(texts: list[bytes], n: int = 5):
    """``shingles`` of each text; about a quarter of a megabyte of short texts is worked on at a time."""
    for group in groups_of(texts):
        yield from _group_shingles(group, n)


def group_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(``word_hashes`` of all texts, one after another; place of each text's first word, and the number of all)."""
    if len(texts) == 1:
        words = word_hashes(texts[0])
        return words, np.array([0, len(words)])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = np.concatenate([[True], _IS_SPACE[raw]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    first, last = turns[::2], turns[1::2]
    ahead, back = (p[: len(raw) + 1] for p in _powers(len(raw) + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * ahead[:-1])])
    words = mixed((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return words, np.searchsorted(first, starts)


def groups_of(texts: list[bytes]):
    """``texts`` in groups of about a quarter of a megabyte."""
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= _PART or k == len(texts) - 1:
            yield group
            group, size = [], 0


def _group_shingles(texts: list[bytes], n: int):
    words, bounds = group_words(texts)
    rolled = words[: max(0, len(words) - n + 1)] + np.uint64(n)
    for j in range(1, n if len(words) >= n else 0):
        rolled = mixed(rolled * _STEP + words[j : len(words) - n + 1 + j])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            few = words[a : a + 1] + np.uint64(b - a)
            for j in range(a + 1, b):
                few = mixed(few * _STEP + words[j : j + 1])
            yield few
        else:
            yield np.zeros(0, np.uint64)
