"""Versions of a table of computed features: what a new state of its sources asks to compute again, and what it lets stand.

A version holds its settings (source of the model, image size, ...), the signature of settings and rows together, and the rows that differ
from the version before. Its commit is one row, written last; a version without it does not exist.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmatch.sources.files import SignatureTree
from catalogmatch.sources.sinks import kept_table

COMMIT = "version int, settings string, signature string, folder string"


class FeatureVersions:
    """The versions at ``path``. Rows are (slug, hash): a key and the hash of what its features are computed from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(COMMIT).json(f"{self.path}/commits/*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def last(self):
        """The newest commit, or None."""
        return self.commits().orderBy(F.desc("version")).first()

    def deltas(self, first: int, last: int) -> DataFrame:
        """(version, slug, hash) of rows that versions ``first`` to ``last`` changed; a null hash says that the row went."""
        folders = {r.version: r.folder for r in self.commits().where(F.col("version").between(first, last)).collect()}
        shape = "slug string, hash string"
        parts = [self.spark.read.schema(shape).parquet(f"{self.path}/rows/{f}").withColumn("version", F.lit(v)) for v, f in sorted(folders.items())]
        out = self.spark.createDataFrame([], f"{shape}, version int")
        for part in parts:
            out = out.unionByName(part)
        return out

    def state(self, version: int | None = None) -> DataFrame:
        """(slug, hash) as of a version; the newest if none is named."""
        newest = self.last()
        version = newest.version if version is None and newest else version or 0
        folded = self.deltas(1, version).groupBy("slug").agg(F.max_by(F.struct("hash"), "version").alias("x"))
        return folded.select("slug", "x.hash").where("hash IS NOT NULL")

    def changes(self, before: int, after: int) -> DataFrame:
        """(slug, action) between two versions: recompute what is new or differs, drop what is gone; rows that changed back are in neither."""
        touched = self.deltas(before + 1, after).select("slug").distinct()
        old, new = (self.state(v).join(touched, "slug", "left_semi") for v in (before, after))
        both = new.withColumnRenamed("hash", "new").join(old.withColumnRenamed("hash", "old"), "slug", "full")
        action = F.when(F.col("new").isNull(), "drop").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "recompute")
        return both.select("slug", action.alias("action")).where("action IS NOT NULL")

    def worklist(self, current: DataFrame, settings: dict[str, str]) -> DataFrame:
        """(slug, action, reason): what a new state of rows and settings asks for.

        Another setting means that every row is computed again; otherwise rows that are new or differ, and rows that are gone are dropped.
        """
        newest = self.last()
        known = json.loads(newest.settings) if newest else settings
        changed = sorted(k for k in {*known, *settings} if known.get(k) != settings.get(k))
        stored = self.state().withColumnRenamed("hash", "stored").withColumn("was", F.lit(True))
        both = current.select("slug", "hash").withColumn("is", F.lit(True)).join(stored, "slug", "full")
        redo = F.lit(bool(changed)) | F.col("was").isNull() | ~F.col("hash").eqNullSafe(F.col("stored"))
        reason = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.lit(bool(changed)), ",".join(changed)).otherwise("changed")
        action = F.when(F.col("is").isNull(), "drop").when(redo, "recompute")
        return both.select("slug", action.alias("action"), reason.alias("reason")).where("action IS NOT NULL")

    def commit(self, current: DataFrame, settings: dict[str, str]) -> int:
        """Makes ``current`` (slug, hash; slugs are distinct, a null hash counts as empty) with ``settings`` the newest version and returns its number.

        Where settings and rows are those of the newest version, no version is made.
        """
        current = kept_table(current.select("slug", F.coalesce("hash", F.lit("")).alias("hash")), "version-rows")
        rows = SignatureTree.of(current, "slug", "hash").root().first().signature
        named = json.dumps(settings, sort_keys=True)
        signature = hashlib.sha256(f"{named}\n{rows}".encode()).hexdigest()
        newest = self.last()
        if newest and newest.signature == signature:
            return newest.version
        stored = self.state()
        new = current.join(stored, ["slug", "hash"], "left_anti").unionByName(stored.join(current, "slug", "left_anti").withColumn("hash", F.lit(None).cast("string")))
        version, folder = (newest.version if newest else 0) + 1, signature[:32]
        new.write.mode("overwrite").parquet(f"{self.path}/rows/{folder}-{version}")
        row = (version, named, signature, f"{folder}-{version}")
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{version}")
        return version
