"""Spelling variants: words at an edit distance of one, by PartEnum signatures of their letter multisets.

A word's letters are a binary vector: letter c in its i-th occurrence is one dimension. Replacing a letter moves two
dimensions (Hamming distance two, equal lengths), inserting or deleting one moves one. The dimensions are dealt to
``partitions`` of about equal weight in the corpus. Of two words whose vectors differ in at most k dimensions, all but at most k
partitions agree; so a word has one signature for each choice of k partitions left out (two for replacements; one for
insertions, in the parts of the longer and of the shorter word), a hash of what stands in the others and of the length. As an edit is in
the first or in the second half of a word, every signature is made twice, with either half as it is written. Words that share a signature
meet in an equi-join and are verified by their edit distance. The signatures are exact: no pair is missed, however many
words share one.

Results in special cases: null and empty texts have no words; a row without an id counts as one with an empty id;
repeated rows count as often as they occur; of near words of equal n the smallest in code-point order is the form; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import map_batches, mixed, table, written

#: Bytes of Latin-1 that are letters here, A-Z in lower case; others part words.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_PART = 1 << 20
_OCCURRENCES = 64


def runs_of(text: str | None, least: int):
    """Maximal runs of letters of at least ``least`` code points, A-Z in lower case, as Latin-1; in parts of about a megabyte."""
    data = (text or "").encode("latin-1", "replace").translate(_LETTER)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + _PART)
        stop = len(data) if stop < 0 else stop
        yield [w for w in data[start:stop].split() if len(w) >= least]
        start = stop


def corpus_words(docs: DataFrame, least: int = 7, drop_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; where ``drop_every`` divides h, the crc32 of ``<id>:<run>``, code point h % length is deleted."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: Counter = Counter()
                for part in runs_of(text.as_py(), least):
                    own.update(part)
                before = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    found[word] += n
            words = [w.decode("latin-1") for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return map_batches(docs.select(F.col(id_col).cast("string"), text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(dimension of each letter, words one after another and each word's letters sorted; length of each word)."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((flat, word))
    flat, word = flat[order], word[order]
    at = np.arange(len(flat))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (word[1:] != word[:-1])
    occurrence = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return flat * _OCCURRENCES + np.minimum(occurrence, _OCCURRENCES - 1), lengths


def _latin(column) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def deal_letters(words: DataFrame, partitions: int) -> np.ndarray:
    """The partition of every dimension: the most frequent first, each to the lightest partition.

    The counts that come to the driver are a row for each letter and occurrence that words hold: 116 letters, 64 occurrences at most.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found, n = np.unique(_letters(_latin(batch.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["dim", "n"])

    counts = words.select("word").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").collect()
    dealt, weight = np.zeros(256 * _OCCURRENCES, np.int64), [0] * partitions
    for row in counts:
        lightest = weight.index(min(weight))
        dealt[row.dim] = lightest
        weight[lightest] += row.n
    return dealt


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) | zlib.adler32(w) << 32 for w in words), np.uint64, len(words))


def signatures(words: DataFrame, dealt: np.ndarray, partitions: int, kind: str) -> DataFrame:
    """(signature, word, n) of ``kind`` "replaced", "longer" (one letter more than its partner) or "shorter"."""
    import pyarrow as pa

    moved = 2 if kind == "replaced" else 1
    left_out = list(combinations(range(partitions), moved))

    def run(batches):
        for batch in batches:
            latin = _latin(batch.column(0))
            dims, lengths = _letters(latin)
            starts = np.cumsum(lengths) - lengths
            hashed, part = mixed((dims + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dealt[dims]
            sums = [np.add.reduceat(np.where(part == p, hashed, np.uint64(0)), starts) for p in range(partitions)]
            total = np.sum(sums, axis=0, dtype=np.uint64)
            shorter = lengths - (kind == "longer")  # of the two lengths
            halves = [_hash([w[: k // 2] for w, k in zip(latin, shorter.tolist(), strict=True)]), _hash([w[k // 2 - k :] for w, k in zip(latin, shorter.tolist(), strict=True)])]
            keys = []
            for number, out in enumerate(left_out):
                rest = total - np.sum([sums[p] for p in out], axis=0, dtype=np.uint64)
                for side, half in enumerate(halves):
                    keys.append(mixed(mixed(rest + np.uint64(2 * number + side)) + half * np.uint64(64) + shorter.astype(np.uint64)))
            k = len(keys)
            take = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, axis=1).ravel().view(np.int64)), *(batch.column(j).take(pa.array(take)) for j in (0, 1))], ["signature", "word", "n"])

    return map_batches(words.select("word", "n"), run, "signature long, word string, n long")


def near_pairs(words: DataFrame, partitions: int = 4) -> DataFrame:
    """(word, n, other, other_n) of all distinct words at an edit distance of one, each pair once; ``words`` has distinct words and is written."""
    dealt = deal_letters(words, partitions)

    def met(kind: str, other: str, condition) -> DataFrame:
        a = signatures(words, dealt, partitions, kind)
        b = signatures(words, dealt, partitions, other).select(F.col("signature"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        return a.join(b, "signature").where(condition & (F.levenshtein("word", "other", 1) == 1)).drop("signature")

    replaced = met("replaced", "replaced", F.col("word") < F.col("other"))
    return replaced.unionByName(met("longer", "shorter", F.lit(True))).distinct()


def spelling_variants(words: DataFrame, partitions: int = 4, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words``, a written table of distinct words and their n.

    A form is the near word of largest n where that is ``times`` the word's or more (``times`` above one, so forms never lead
    back); the root is where forms lead.
    """
    pairs = near_pairs(words, partitions)
    both = pairs.select("word", "n", F.struct((-F.col("other_n")).alias("rest"), F.col("other").alias("word")).alias("near"))
    both = both.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.struct((-F.col("n")).alias("rest"), "word").alias("near")))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    formed = -F.col("near.rest") >= times * F.col("n")
    near = written(near.select("word", "n_near", F.when(formed, F.col("near.word")).alias("form"), F.when(formed, -F.col("near.rest")).alias("form_n")), "near-words")
    roots = written(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # n grows by ``times`` a step, and each round doubles the steps taken
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            break
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 letters and more that occur twice or more, with their near words, forms and roots."""
    words = corpus_words(table(spark, sf_dir, "documents")).where("n >= 2")
    return spelling_variants(written(words, "variant-words"))
