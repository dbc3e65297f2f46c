"""Checksums, manifests, incremental worklists and quality gates over files and rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogmatch.sources.sinks import kept_table

def with_sha256(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, sha256) of binary files."""
    return files.select("path", F.sha2(F.col(content), 256).alias("sha256"))


def manifest_status(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, expected, actual, status): match, mismatch, missing or unexpected."""
    both = manifest.select("path", F.col("sha256").alias("expected")).join(found.select("path", F.col("sha256").alias("actual")), "path", "full")
    status = F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").when(F.col("expected") == F.col("actual"), "match").otherwise("mismatch")
    return both.withColumn("status", status)


def worklist(current: DataFrame, stored: DataFrame, key: str = "slug", hash_col: str = "hash") -> DataFrame:
    """(key, action): what to recompute (new or changed rows) and what to drop (rows that are gone)."""
    redo = current.join(stored, [key, hash_col], "left_anti").select(key, F.lit("recompute").alias("action"))
    gone = stored.join(current, key, "left_anti").select(key, F.lit("drop").alias("action"))
    return redo.unionByName(gone)


def corpus_signature(texts: DataFrame, key: str = "slug", text: str = "text", parts: int | None = 64) -> DataFrame:
    """(signature): one SHA-256 over all texts in key order.

    The signature is taken over the digests of ``parts`` hash-dealt parts, each over the digests of its texts. With None the
    texts themselves are joined by line breaks in one place, which only suits a catalog-sized table.
    """
    joined = lambda rows, sep: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), sep).cast("binary"), 256)
    if parts is None:
        return texts.agg(joined(F.struct(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")), "\n").alias("signature"))
    part = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts)).alias("part")
    rows = texts.select(part, F.struct(F.col(key).alias("k"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("t")).alias("x"))
    digests = rows.groupBy("part").agg(joined(F.col("x"), "\n").alias("d"))
    return digests.agg(joined(F.struct(F.col("part").alias("k"), F.col("d").alias("t")), "\n").alias("signature"))


#: Children of an inner node of a signature tree (a hexadecimal digit), rows of a leaf on average at most, and rows it may hold.
FAN_OUT, LEAF_ROWS, MOST_LEAF_ROWS = 16, 16, 128


def _folded(rows: DataFrame, key: list[str], item: str, order: str, most: int | None = MOST_LEAF_ROWS) -> DataFrame:
    """One digest for each ``key`` over its items in order; more than ``most`` of them are an error, None allows any number."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))
    folded = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["i"]), "\n").cast("binary"), 256).alias("digest"))
    if most is None:
        return folded
    full = F.raise_error(F.concat(F.lit("too many rows for a node of the signature tree: "), F.col("n").cast("string"))).cast("string")
    return folded.withColumn("digest", F.when(F.col("n") <= most, F.col("digest")).otherwise(full))


def tree_leaves(texts: DataFrame, key: str = "slug", text: str = "text") -> DataFrame:
    """(place, key, row): what a signature tree is made of, a row for each distinct key and text: the key's place in the tree and both digested."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = texts.select(F.md5(k.cast("binary")).alias("place"), k.alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("own"))
    counted = rows.groupBy("place", "key", "own").agg(F.count("*").alias("times"))
    return counted.select("place", "key", F.concat_ws(":", "key", "own", F.col("times").cast("string")).alias("row"))


def _nodes(leaves: DataFrame, levels: int, most: int | None) -> DataFrame:
    """(level, node, n, digest) of the leaves that hold ``leaves``."""
    return _folded(leaves.select(F.substring("place", 1, levels).alias("node"), "row"), ["node"], "row", "row", most).select(F.lit(levels).alias("level"), "node", "n", "digest")


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The parents of all nodes of a level."""
    rows = nodes.select(F.substring("node", 1, level - 1).alias("parent"), "node", F.concat_ws(":", "node", "digest").alias("child"))
    return _folded(rows, ["parent"], "child", "node").select(F.lit(level - 1).alias("level"), F.col("parent").alias("node"), "n", "digest")


def levels_for(n_rows: int) -> int:
    """How deep a tree over ``n_rows`` rows is."""
    levels = 0
    while n_rows > LEAF_ROWS * FAN_OUT**levels:
        levels += 1
    return levels


class SignatureTree:
    """A hash tree over a corpus: ``leaves`` (place, key, row) and ``nodes`` (level, node, n, digest), both written.

    A leaf holds the rows whose key's MD5 begins with its name, an inner node digests its children; no group of any level holds more than
    ``FAN_OUT`` children or ``most`` rows, however large the corpus. Where readers fix the depth, ``most`` is None: a leaf then holds its
    share of the corpus, one part in ``FAN_OUT ** levels``, whatever that is.
    """

    def __init__(self, leaves: DataFrame, nodes: DataFrame, levels: int, most: int | None = MOST_LEAF_ROWS):
        self.leaves, self.nodes, self.levels, self.most = leaves, nodes, levels, most

    @staticmethod
    def of(texts: DataFrame, key: str = "slug", text: str = "text", levels: int | None = None, most: int | None = MOST_LEAF_ROWS) -> SignatureTree:
        leaves = kept_table(tree_leaves(texts, key, text), "tree-leaves")
        levels = levels_for(leaves.count()) if levels is None else levels
        nodes = level = kept_table(_nodes(leaves, levels, most), "tree-nodes")
        for k in range(levels, 0, -1):
            level = _above(level, k)
            nodes = nodes.unionByName(level)
        return SignatureTree(leaves, kept_table(nodes, "tree-nodes"), levels, most)

    def root(self) -> DataFrame:
        """(signature): the root's digest; of an empty corpus the digest of nothing."""
        return self.nodes.where("level = 0").agg(F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("signature"))

    def updated(self, changed: DataFrame, removed: DataFrame | None = None, key: str = "slug", text: str = "text") -> SignatureTree:
        """The tree after ``changed`` rows (key, text) have replaced those of their keys and ``removed`` keys have gone.

        Only leaves that hold such a key, and the nodes above them, are computed; all others keep their digests.
        """
        new = kept_table(tree_leaves(changed, key, text), "tree-changes")
        keys = new.select("place", "key")
        if removed is not None:
            gone = F.coalesce(F.col(key).cast("string"), F.lit(""))
            keys = keys.unionByName(removed.select(F.md5(gone.cast("binary")).alias("place"), gone.alias("key")))
        keys = kept_table(keys.distinct(), "tree-keys")
        leaves = kept_table(self.leaves.join(keys, ["place", "key"], "left_anti").unionByName(new), "tree-leaves")
        touched = kept_table(keys.select(F.substring("place", 1, self.levels).alias("node")).distinct(), "tree-touched")
        level = _nodes(leaves.withColumn("node", F.substring("place", 1, self.levels)).join(touched, "node", "left_semi").drop("node"), self.levels, self.most)
        nodes = None
        for k in range(self.levels, -1, -1):
            names = touched.select(F.substring("node", 1, k).alias("node")).distinct()
            old = self.nodes.where(F.col("level") == k).join(names, "node", "left_anti")
            whole = kept_table(old.unionByName(level), "tree-level")
            nodes = whole if nodes is None else nodes.unionByName(whole)
            if k:
                parents = touched.select(F.substring("node", 1, k - 1).alias("parent")).distinct()
                level = _above(whole.withColumn("parent", F.substring("node", 1, k - 1)).join(parents, "parent", "left_semi").drop("parent"), k)
        return SignatureTree(leaves, nodes, self.levels, self.most)


def image_format(content: Column) -> Column:
    """JPEG, PNG or WEBP by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")


def gated_images(images: DataFrame, max_bytes: int = 12 * 1024 * 1024, max_pixels: int = 24_000_000, least_side: int = 32) -> DataFrame:
    """``images`` (format, width, height, n_bytes) with ``code`` and ``reason`` of the first rule that fails, null where all pass."""
    width, height = F.col("width"), F.col("height")
    rules = [
        (F.col("n_bytes") > max_bytes, 413, "too_many_bytes"),
        (F.col("format").isNull() | width.isNull() | height.isNull(), 422, "unreadable"),
        (~F.col("format").isin("JPEG", "PNG", "WEBP"), 415, "format"),
        (width.cast("long") * height > max_pixels, 413, "too_many_pixels"),
        (F.least(width, height) < least_side, 422, "too_small"),
    ]
    code, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for test, number, name in reversed(rules):
        code, reason = F.when(test, number).otherwise(code), F.when(test, name).otherwise(reason)
    return images.withColumn("code", code).withColumn("reason", reason)


def violations(**checks: Column) -> Column:
    """Names of the checks that fail (a null check fails), as an array."""
    return F.filter(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())), lambda x: x.isNotNull())


def candidate_checks(slug: Column, confidence: Column) -> dict[str, Column]:
    """Checks of one candidate: a slug of 1 to 300 characters, a finite confidence between 0 and 1."""
    return {"slug_length": F.length(slug).between(1, 300), "confidence_range": confidence.between(0, 1) & ~F.isnan(confidence)}


def question_checks(question: Column, least: int = 2, most: int = 500) -> dict[str, Column]:
    """Checks of a question: between ``least`` and ``most`` characters."""
    return {"question_length": F.length(question).between(least, most)}


def prediction_checks(candidates: Column, most: int = 20) -> dict[str, Column]:
    """Checks of a prediction: at most ``most`` candidates (struct<slug,confidence>), each of which passes its own checks."""
    good = F.forall(candidates, lambda c: F.coalesce(functools.reduce(lambda a, b: a & b, candidate_checks(c["slug"], c["confidence"]).values()), F.lit(False)))
    return {"candidate_count": F.size(candidates) <= most, "candidates": good}


def value_checks(**values: tuple[Column, tuple[str, ...]]) -> dict[str, Column]:
    """Checks that a column holds one of the values that are allowed for it."""
    return {name: column.isin(*known) for name, (column, known) in values.items()}


def valid_session(session: Column) -> Column:
    """32 lower-case hexadecimal digits."""
    return F.coalesce(session.rlike("^[a-f0-9]{32}$"), F.lit(False))
