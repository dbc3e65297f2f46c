"""From documents to token ids: quality, exact copies, near copies, benchmark leaks, encoding.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``. Special cases (nulls, empty and very long texts, repeated rows, empty tables) have the results that the
operators' modules state; extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.llm.bpe import encode
from catalogmatch.llm.common import table, written
from catalogmatch.llm.decontaminate import drop_leaking
from catalogmatch.llm.exact import drop_exact_copies
from catalogmatch.llm.minhash import drop_near_copies
from catalogmatch.llm.quality import fit_quality

#: Documents scored below this go; the threshold of the quality query.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fit_quality(docs, table(spark, sf_dir, "labels")).keep(docs, LEAST_QUALITY)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    found = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", keep_distinct),
    ("near dedup", keep_one_per_group),
    ("decontamination", keep_unleaked),
    ("byte-level BPE", to_tokens),
]

#: Two of the stages learn or hash in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
