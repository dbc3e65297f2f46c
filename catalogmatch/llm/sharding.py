"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group, which goes to one shard as a whole; only a group of more bytes than a whole shard is
split, because bytes could not be level otherwise, into as few pieces as shards can hold. Every group is placed, largest
groups first, where the dot product of its size vector with the shard's residual capacity is highest, among the shards
that have room for its bytes if any has. Groups above
``1 / fineness`` of a shard, a number bounded whatever the input, are placed on the driver. The others are dealt to
tasks, about ``groups_a_task`` to each; a task has its part of every shard's residual capacity and places its groups
against it.

Results in special cases: null texts count as empty; rows without an id are placed like others; repeated rows stay together
and get slots of their own; ties go to the lower shard in an order that differs from task to task; an empty table gives an
empty result; other columns of any name pass through ``write_shards``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.llm.common import WORD, map_batches, sized, table, unused, written

DIMS = ("size", "tokens", "one")
#: How much each dimension counts in the dot product: bytes, the balance that is promised, count double.
WEIGHTS = (2.0, 1.0, 1.0)


def pack(items: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each item (rows of sizes); largest first, to the highest dot product with ``left``, the shards' residual capacities, which it lessens.

    Shards with room for its bytes come first, so bytes stay level where a group has more tokens or rows than a shard.
    """
    out = np.zeros(len(items), np.int64)
    for k in np.argsort(-items.max(axis=1), kind="stable"):
        score, fits = left @ (items[k] * WEIGHTS), left[:, 0] >= items[k, 0]
        out[k] = np.argmax(np.where(fits, score, -np.inf) if fits.any() else score)
        left[out[k]] -= items[k]
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, one, grp, row) of every row; ``grp`` is equal for equal texts. ``tokens`` (by default words) counts a row's tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.regexp_count(text, F.lit(WORD)) if tokens is None else tokens).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("one"),
        F.xxhash64(text).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
    )


def _large_homes(groups: DataFrame, n_shards: int) -> tuple[DataFrame, np.ndarray]:
    """((grp, piece, pieces, shard) of the large groups, placed on the driver; what they leave of every shard's capacity, in shares of a shard)."""
    found = groups.orderBy("grp").toArrow()
    pieces = found["pieces"].to_numpy()
    items = np.repeat(np.column_stack([found[f"{d}_share"].to_numpy() for d in DIMS]).reshape(-1, len(DIMS)) / pieces[:, None], pieces, axis=0)
    left = np.ones((n_shards, len(DIMS)))
    shards = pack(items, left)
    order = np.concatenate([np.arange(n) for n in pieces.tolist()]) if len(pieces) else np.zeros(0, int)
    rows = zip(np.repeat(found["grp"].to_numpy(), pieces).tolist(), order.tolist(), np.repeat(pieces, pieces).tolist(), shards.tolist(), strict=True)
    return groups.sparkSession.createDataFrame(list(rows), "grp long, piece int, pieces int, shard int"), left


def _small_homes(groups: DataFrame, left: np.ndarray, groups_a_task: int) -> DataFrame:
    """(grp, shard) of the other groups; each task places its own."""
    import pyarrow as pa
    from pyspark import TaskContext

    n_shards = len(left)
    free = np.maximum(left, 1e-9)
    free = free / free.sum(axis=0) * n_shards

    def place(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            rows = pa.Table.from_batches(batches).sort_by("grp")
            items = np.column_stack([rows[d].to_numpy().astype(float) for d in DIMS])
            items = items / np.maximum(items.sum(axis=0), 1e-12) * n_shards
            turn = np.random.default_rng(TaskContext.get().partitionId()).permutation(n_shards)
            homes = turn[pack(items, free[turn].copy())]
            yield from pa.table({"grp": rows["grp"], "shard": pa.array(homes.astype(np.int32))}).to_batches()

    tasks = max(1, -(-groups.count() // groups_a_task))
    return map_batches(groups.select("grp", *DIMS).repartition(tasks, "grp"), place, "grp long, shard int")


def shard(
    docs: DataFrame, n_shards: int = 8, fineness: int = 64, groups_a_task: int = 100_000, id_col: str = "doc_id", text_col: str = "text", cells: int = 512, rows_a_cell: int = 1_000_000, tokens: Column | None = None
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots run gapless from 0 in every shard.

    At most ``3 * fineness * n_shards`` groups reach the driver. ``cells`` is how many parts of a shard are numbered in parallel;
    there are more where these would hold over ``rows_a_cell`` rows. Rows are dealt to them one by one, whatever their ids and texts.
    """
    rows = written(measured(docs, id_col, text_col, tokens), "shard-rows")
    totals = rows.agg(*(F.sum(d) for d in DIMS), F.count("*").alias("n_rows")).first()
    if totals[0] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = rows.groupBy("grp").agg(*(F.sum(d).alias(d) for d in DIMS))
    groups = groups.select("*", *((F.col(d) / F.lit(float(max(1, t))) * n_shards).alias(f"{d}_share") for d, t in zip(DIMS, totals, strict=False)))
    groups = written(groups.withColumn("pieces", F.greatest(F.lit(1), F.ceil("size_share")).cast("int")), "shard-groups")
    is_large = F.greatest(*(f"{d}_share" for d in DIMS)) > 1 / fineness
    large, left = _large_homes(groups.where(is_large), n_shards)
    large = F.broadcast(large)  # at most 3 * fineness * n_shards groups, n_shards more pieces
    small = sized(written(_small_homes(groups.where(~is_large), left, groups_a_task), "shard-homes"))
    out = ["doc_id", "size", "text_crc32", "shard", "row"]
    cells = max(cells, -(-int(totals["n_rows"]) // (n_shards * rows_a_cell)))
    in_large = rows.join(large, "grp").where(F.col("piece") == F.pmod(F.xxhash64("row"), "pieces"))
    others = rows.join(F.broadcast(large.select("grp").distinct()), "grp", "left_anti").join(small, "grp")
    homed = in_large.select(*out).unionByName(others.select(*out)).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    homed = written(homed, "shard-homed")
    counts = homed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # n_shards * cells rows
    first = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "row"))
    return homed.withColumn("place", place).join(F.broadcast(first), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes ``docs`` to ``path``, one folder per shard, rows in slot order within files.

    Returns the name of the folders' column: ``shard``, lengthened where ``docs`` has a column of that name.
    """
    an_id, a_crc, home, slot = unused(docs, "home_id", "home_crc", "shard", "slot")
    homes = shard(docs, n_shards, id_col=id_col, text_col=text_col).groupBy(F.col("doc_id").alias(an_id), F.col("text_crc32").alias(a_crc))
    homes = homes.agg(F.min("shard").alias(home), F.min("slot").alias(slot))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.join(homes, F.col(id_col).eqNullSafe(F.col(an_id)) & (crc == F.col(a_crc))).drop(an_id, a_crc)
    out.sortWithinPartitions(home, slot).drop(slot).write.partitionBy(home).parquet(path)
    return home


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot; sizes are balanced (law ``bytes``)."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
