"""Exact dedup by composable polynomial fingerprints.

Texts are equal when they are identical after every run of white space became one space. The fingerprint of a text is the
value of the polynomial whose coefficients are its UTF-8 bytes, modulo two primes. Texts beyond ``piece`` characters are
cut into pieces that are hashed in parallel; piece hashes combine by shifting each by the length before it. One pass
normalises, cuts and hashes the texts and writes the pieces beside their hashes.

Equal fingerprints are proved piece by piece: of every group with several rows the smallest and the largest text of a
piece must be the same, an aggregate that combines before the shuffle. Only groups in which they differ, different texts
of one fingerprint, are compared with the row of the smallest id; rows that differ from it form groups of their own.

Results in special cases: null texts count as empty, and empty texts are equal to each other; a row without an id never
is the one that stays while its group has an id, and is not kept; rows that repeat both the id and the text of the row
that stays are all marked kept; an empty table gives an empty result. Other columns of any name pass through
``drop_exact_copies``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.common import grouped_join, map_batches, sized, table, unused, written

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)
SPAN = 1 << 16
KEY = ["n_bytes", "h1", "h2", "round"]
#: The runs of white space that are not a single space already.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo ``prime``."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


def fingerprint(data: np.ndarray, tables: list[np.ndarray], primes=PRIMES, bases=BASES) -> list[int]:
    """Per prime, the sum of data[i] * base**i; spans are hashed one by one and combined by length-shifted arithmetic."""
    out = []
    for prime, base, table_ in zip(primes, bases, tables, strict=True):
        total, shift = 0, 1
        for start in range(0, len(data), SPAN):
            span = data[start : start + SPAN]
            total = (total + shift * (int(np.dot(span, table_[: len(span)])) % prime)) % prime
            shift = shift * pow(base, len(span), prime) % prime
        out.append(total)
    return out


def _hashed(pieces: DataFrame, primes, bases) -> DataFrame:
    """``pieces`` with n_bytes, h1, h2 and the shifts s1, s2 of its column ``piece``."""
    import pyarrow as pa

    names = [*pieces.columns, "n_bytes", "h1", "h2", "s1", "s2"]

    def run(batches):
        tables = [powers(b, p, SPAN) for b, p in zip(bases, primes, strict=True)]
        for batch in batches:
            texts = batch.column("piece").cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            rows = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                hashes = fingerprint(raw[a:b].astype(np.uint64), tables, primes, bases)
                rows.append((b - a, *hashes, *(pow(x, b - a, p) for x, p in zip(bases, primes, strict=True))))
            found = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(5))], names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema), *(f"{c} long" for c in names[-5:])])
    return map_batches(pieces, run, schema)


def normalised(text_col: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), RUNS, " ")


def hashed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 20, primes=PRIMES, bases=BASES) -> DataFrame:
    """(doc_id, text_sha256, n_pieces, k, piece, n_bytes, h1, h2, s1, s2): the normalised texts in pieces of ``piece`` characters."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("text"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / piece)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n_pieces") - 1), lambda k: F.struct(k.alias("k"), F.col("text").substr(k * piece + 1, F.lit(piece)).alias("piece")))
    rows = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), n.alias("n_pieces"), "text")
    return _hashed(rows.select("doc_id", "text_sha256", "n_pieces", F.inline(cut)), primes, bases)


def _whole(pieces: DataFrame, primes) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, h1, h2, copies) of the texts of several pieces; repeated rows count in ``copies``."""
    hashes = pieces.where("n_pieces > 1").groupBy("doc_id", "text_sha256", "k", "n_bytes", "h1", "h2", "s1", "s2").agg(F.count("*").alias("copies"))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("k", "n_bytes", "h1", "h2", "s1", "s2"))),  # one row per piece
        F.struct(*(F.lit(v).cast("long").alias(c) for c, v in (("n_bytes", 0), ("h1", 0), ("h2", 0), ("s1", 1), ("s2", 1)))),
        lambda acc, x: F.struct(
            (acc.n_bytes + x.n_bytes).alias("n_bytes"),
            ((acc.h1 + acc.s1 * x.h1) % primes[0]).alias("h1"),
            ((acc.h2 + acc.s2 * x.h2) % primes[1]).alias("h2"),
            (acc.s1 * x.s1 % primes[0]).alias("s1"),
            (acc.s2 * x.s2 % primes[1]).alias("s2"),
        ),
    )
    sums = hashes.groupBy("doc_id", "text_sha256").agg(joined.alias("x"), F.max("copies").cast("int").alias("copies"))
    return sums.select("doc_id", "text_sha256", "x.n_bytes", "x.h1", "x.h2", "copies")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 20, primes=PRIMES, bases=BASES) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, h1, h2) of every row; texts beyond ``piece`` characters are hashed in pieces."""
    pieces = written(hashed_pieces(docs, id_col, text_col, piece, primes, bases), "exact-pieces")
    return _fingerprints(pieces, _whole(pieces, primes))


def _fingerprints(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    one = ["doc_id", "text_sha256", "n_bytes", "h1", "h2"]
    again = whole.select(*one, F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*one)
    return pieces.where("n_pieces = 1").select(*one).unionByName(again)


def _keyed_pieces(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, n_pieces, k, piece, n_bytes, h1, h2): pieces beside the fingerprint of their whole text."""
    kept = ["doc_id", "text_sha256", "n_pieces", "k", "piece"]
    own = whole.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "n_bytes", "h1", "h2")
    long = pieces.where("n_pieces > 1").select(*kept).join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")))
    out = [*kept, "n_bytes", "h1", "h2"]
    return pieces.where("n_pieces = 1").select(*out).unionByName(long.select(*out))


def _shared_by_different(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The fingerprints of ``groups`` whose members are not all equal: some piece has a smallest and another largest text."""
    key = KEY[:-1]
    members = texts.join(sized(groups.select(*key)), key, "left_semi")
    span = members.groupBy(*key, "k").agg(F.min("piece").alias("least"), F.max("piece").alias("most"), F.min("n_pieces").alias("n"), F.max("n_pieces").alias("m"))
    return span.where("least <> most OR n <> m").select(*key).distinct()


def _unequal(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of the ``rows`` whose text differs from that of the row that stays, compared piece by piece."""
    key = KEY[:-1]
    members = rows.where("group_size > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "keep_id").distinct()
    pieces = texts.join(members, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")))
    #: One text of the row that stays; where its id stands at several texts, the one with the smallest digest.
    first = rows.where("group_size > 1 AND doc_id <=> keep_id").groupBy(*key).agg(F.min("text_sha256").alias("text_sha256"))
    kept = pieces.where("doc_id <=> keep_id").join(first, [*key, "text_sha256"], "left_semi").groupBy(*key, "k").agg(F.min("piece").alias("kept_piece"), F.max("n_pieces").alias("kept_n"))
    same = F.coalesce((F.col("piece") == F.col("kept_piece")) & (F.col("n_pieces") == F.col("kept_n")), F.lit(False))
    return pieces.join(kept, [*key, "k"], "left").where(~same).select("doc_id", "text_sha256").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 20, primes=PRIMES, bases=BASES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    pieces = written(hashed_pieces(docs, id_col, text_col, piece, primes, bases), "exact-pieces")
    whole = written(_whole(pieces, primes), "exact-whole")
    todo = _fingerprints(pieces, whole).withColumn("round", F.lit(0))
    of_groups = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    groups = written(todo.groupBy(*KEY).agg(*of_groups).where("group_size > 1"), "exact-groups")
    texts = _keyed_pieces(pieces, whole)
    shared = written(_shared_by_different(texts, groups), "exact-shared")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    alone = lambda rows: rows.withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    if shared.isEmpty():
        done = alone(grouped_join(todo, groups, KEY, "group_size")).select(*out)
    else:
        #: Fingerprints shared by different texts: the equal ones stay together, the others go on to the next round.
        plain = todo.join(sized(shared), KEY[:-1], "left_anti")
        done = alone(grouped_join(plain, groups, KEY, "group_size")).select(*out)
        todo = written(todo.join(sized(shared), KEY[:-1], "left_semi"), "exact-todo")
        texts = written(texts.join(sized(shared), KEY[:-1], "left_semi"), "exact-texts")
        while not todo.isEmpty():
            rows = alone(todo.join(todo.groupBy(*KEY).agg(*of_groups), KEY))
            differ = written(_unequal(texts, rows), "exact-unequal")
            pair = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
            equal = rows.alias("a").join(differ.alias("b"), pair, "left_anti")
            part = equal.drop("group_size").join(equal.groupBy(*KEY).agg(F.count("*").alias("group_size")), KEY)
            done = done.unionByName(written(part.select(*out), "exact-done"))
            todo = written(todo.alias("a").join(differ.alias("b"), pair, "left_semi").withColumn("round", F.col("round") + 1), "exact-todo")
    return done.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone_id, gone_sha = unused(docs, "gone_id", "gone_sha")
    gone = exact_groups(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    sha = F.sha2(normalised(text_col).cast("binary"), 256)
    return docs.join(sized(written(gone, "exact-gone")), F.col(id_col).eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha)), "left_anti")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
