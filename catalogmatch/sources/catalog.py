"""Readers of the catalog, its profiles, image folders and the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.functions.text import quoted

COLUMNS = ("slug", "name", "category", "color", "region", "grapes", "description", "winery", "near_dup_group")
PROFILE = (
    "slug string, profile struct<sweetness:string,body:string,acidity:string,tannins:string,serve_temp:string,"
    "sparkling:boolean,aromas:array<string>,pairing:array<string>>, problems array<string>"
)
PREDICTION = "query_id string, image_path string, image_sha256 string, predicted_slug string, latency_ms long"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog CSV (header, quotes, line breaks in fields, optional byte order mark). Absent columns and values are ""; ``pos`` is the file order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    rating = F.col(f"`{names['rosquality_rating']}`").try_cast("double") if "rosquality_rating" in names else F.lit(None).cast("double")
    kept = [F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in COLUMNS]
    return raw.select(*kept, rating.alias("rosquality_rating"), F.monotonically_increasing_id().alias("pos"))


def checked_catalog(catalog: DataFrame) -> DataFrame:
    """``catalog`` with ``reason``: why a row cannot be used (empty_slug, separator_in_slug, repeated_slug), null for good rows.

    Of repeated slugs the first in file order is good.
    """
    again = F.row_number().over(Window.partitionBy("slug").orderBy("pos")) > 1
    reason = (
        F.when(F.coalesce("slug", F.lit("")) == "", "empty_slug")
        .when(F.col("slug").rlike(r"[/\\]"), "separator_in_slug")
        .when(again, "repeated_slug")
    )
    return catalog.withColumn("reason", reason)


def strict_catalog(catalog: DataFrame) -> DataFrame:
    """``catalog`` as it is, or an error when the query runs: for any row that cannot be used."""
    checked = checked_catalog(catalog)
    stop = F.raise_error(F.concat(F.lit("unusable catalog row: "), F.col("reason"), F.lit(" "), F.coalesce("slug", F.lit("")))).cast("string")
    return checked.withColumn("slug", F.when(F.col("reason").isNull(), F.col("slug")).otherwise(stop)).drop("reason")


def split_catalog(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason)."""
    checked = checked_catalog(catalog)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def is_empty_catalog(catalog: DataFrame) -> DataFrame:
    """One row, ``empty``: whether there is no usable row."""
    return split_catalog(catalog)[0].agg((F.count("*") == 0).alias("empty"))


def with_urls(catalog: DataFrame, image_base: str = "/api/catalog/", image_end: str = "/image", source_base: str = "https://example.com/items/") -> DataFrame:
    """``catalog`` with image_url and source_url."""
    slug = quoted(F.col("slug"))
    return catalog.withColumn("image_url", F.concat(F.lit(image_base), slug, F.lit(image_end))).withColumn("source_url", F.concat(F.lit(source_base), slug))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile lines, with their place in the input."""
    return spark.read.schema(PROFILE).json(path).withColumn("line", F.monotonically_increasing_id())


def usable_profiles(profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """(slug, profile): lines without problems whose slug is in the catalog; the last line of a slug wins."""
    good = profiles.where(F.coalesce(F.size("problems"), F.lit(0)) <= 0).join(catalog.select("slug").distinct(), "slug", "left_semi")
    return good.groupBy("slug").agg(F.max_by("profile", "line").alias("profile"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def read_images(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) of image files under the paths, each file once; suffixes in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).dropDuplicates(["path"])


def required_images(images: DataFrame) -> DataFrame:
    """``images``; a ValueError if there is none."""
    if images.isEmpty():
        raise ValueError("no images found")
    return images


def gallery_files(images: DataFrame, preferred: str = "refs") -> tuple[DataFrame, DataFrame]:
    """((slug, path), repeated slugs): one file per slug, the slug is the file's stem; where a ``preferred`` folder exists only its files count."""
    marked = images.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("slug"), "path", F.contains("path", F.lit(f"/{preferred}/")).alias("inside"))
    any_inside = F.broadcast(marked.agg(F.coalesce(F.bool_or("inside"), F.lit(False)).alias("any_inside")))  # one row
    rows = marked.join(any_inside, F.col("inside") | ~F.col("any_inside")).select("slug", "path")
    repeated = rows.groupBy("slug").count().where("count > 1").select("slug", "count")
    return rows.join(repeated, "slug", "left_anti"), repeated
