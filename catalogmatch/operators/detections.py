"""Selection and pairing of detection boxes per image.

Detections: (image_id, det_id, class_id, confidence, box struct<x1,y1,x2,y2>); images: (image_id, width, height).
Scores and their gaps count to nine places; equal scores are ordered by det_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.functions import geometry as G

BOTTLE, LABEL = 0, 1


@dataclass(frozen=True)
class Selection:
    """When a second box is kept beside the best: score gap, gap of axis distances, overlap and least confidence."""

    score_gap: float = 0.06
    distance_gap: float = 0.08
    overlap: float = 0.5
    least_confidence: float = 0.0


LABELS = Selection()
BOTTLES = Selection(overlap=0.8, least_confidence=0.75)


def confident(detections: DataFrame, least: float = 0.05) -> DataFrame:
    return detections.where(F.col("confidence") >= least)


def class_counts(detections: DataFrame) -> DataFrame:
    """(image_id, bottles, labels)."""
    return detections.groupBy("image_id").agg(F.count_if(F.col("class_id") == BOTTLE).alias("bottles"), F.count_if(F.col("class_id") == LABEL).alias("labels"))


def scored(detections: DataFrame, images: DataFrame, axis_x: float = 0.5) -> DataFrame:
    """Detections with image size, axis distance and selection score."""
    rows = detections.join(images, "image_id")
    rows = rows.withColumn("distance", G.axis_distance(F.col("box"), F.col("width"), axis_x))
    return rows.withColumn("score", G.selection_score(F.col("confidence"), F.col("distance")))


def select_targets(rows: DataFrame, rule: Selection = LABELS) -> DataFrame:
    """Of scored detections of one class, the best of each image and, where it is ambiguous, the second; ``place`` 1 or 2, ``ambiguous``."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    ranked = rows.withColumn("place", F.row_number().over(w)).where("place <= 2")
    pair = Window.partitionBy("image_id").orderBy("place")
    other = lambda c: F.coalesce(F.lead(c).over(pair), F.lag(c).over(pair))  # noqa: E731  the one other row of the image
    ranked = ranked.withColumns({f"_{c}": other(c) for c in ("score", "distance", "confidence", "box")})
    close = (
        (F.round(F.abs(F.col("score") - F.col("_score")), G.PLACES) <= rule.score_gap)
        & (F.abs(F.col("distance") - F.col("_distance")) <= rule.distance_gap)
        & (G.iou(F.col("box"), F.col("_box")) < rule.overlap)
        & (F.least("confidence", "_confidence") >= rule.least_confidence)
    )
    ranked = ranked.withColumn("ambiguous", F.coalesce(close, F.lit(False)))
    return ranked.where("place = 1 OR ambiguous").drop("_score", "_distance", "_confidence", "_box")


def pair_bottles(labels: DataFrame, bottles: DataFrame) -> DataFrame:
    """Each label with its bottle: among the bottles around the label's centre the one of best overlap, then confidence; else the nearest.

    All bottles of the image compete; labels of images without bottles stay, with nulls.
    """
    own = bottles.select("image_id", F.col("det_id").alias("bottle_det"), F.col("confidence").alias("bottle_confidence"), F.col("box").alias("bottle_box"))
    rows = labels.join(own, "image_id", "left")
    box, around = F.col("box"), F.col("bottle_box")
    x, y = (box.x1 + box.x2) * 0.5, (box.y1 + box.y2) * 0.5
    inside = x.between(around.x1, around.x2) & y.between(around.y1, around.y2)
    best = F.struct(
        inside.cast("int").alias("inside"),
        F.when(inside, G.iou(box, around)).otherwise(0.0).alias("overlap"),
        F.when(inside, F.col("bottle_confidence")).otherwise(0.0).alias("confidence"),
        F.when(inside, 0.0).otherwise(-G.point_distance(x, y, around)).alias("nearness"),
    )
    rows = rows.withColumn("_b", best)
    w = Window.partitionBy("image_id", "det_id").orderBy(F.desc("_b"), "bottle_det")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_b", "_n")


def selection_modes(images: DataFrame, detections: DataFrame, axis_x: float = 0.5) -> DataFrame:
    """(image_id, bottles, labels, mode): no_label_detection, ambiguous_two_pairs or single_pair."""
    labels = scored(detections.where(F.col("class_id") == LABEL), images, axis_x)
    chosen = select_targets(labels).where("place = 1").select("image_id", "ambiguous")
    rows = images.select("image_id").join(class_counts(detections), "image_id", "left").join(chosen, "image_id", "left")
    mode = F.when(F.col("ambiguous").isNull(), "no_label_detection").when(F.col("ambiguous"), "ambiguous_two_pairs").otherwise("single_pair")
    return rows.select("image_id", F.coalesce("bottles", F.lit(0)).cast("long").alias("bottles"), F.coalesce("labels", F.lit(0)).cast("long").alias("labels"), mode.alias("mode"))


def _crops(rows: DataFrame, threshold: float, low: str) -> DataFrame:
    width, height = F.col("width"), F.col("height")
    mode = G.crop_mode(F.col("bottle_confidence"), threshold, low)
    return rows.withColumn("label_crop", F.when(F.col("label_box").isNotNull(), G.padded_box(F.col("label_box"), width, height, 0.10))).withColumn("bottle_mode", mode).withColumn(
        "bottle_crop", F.when(mode == "yolo_bottle_crop", G.padded_box(F.col("bottle_box"), width, height, 0.06))
    )


def _ambiguous(one, two, rule: Selection):
    """Whether the second box stays beside the best; false without a second."""
    close = (
        (F.round(F.abs(one["score"] - two["score"]), G.PLACES) <= rule.score_gap)
        & (F.abs(one["distance"] - two["distance"]) <= rule.distance_gap)
        & (G.iou(one["box"], two["box"]) < rule.overlap)
        & (F.least(one["confidence"], two["confidence"]) >= rule.least_confidence)
    )
    return F.coalesce(close, F.lit(False))


def _rivalry(label, box, confidence, det):
    """What orders the bottles of a label, the best first: as in ``pair_bottles``."""
    x, y = (label["box"].x1 + label["box"].x2) * 0.5, (label["box"].y1 + label["box"].y2) * 0.5
    inside = x.between(box.x1, box.x2) & y.between(box.y1, box.y2)
    return F.struct(
        (-inside.cast("int")).alias("outside"), F.when(inside, -G.iou(label["box"], box)).otherwise(0.0).alias("overlap"), F.when(inside, -confidence).otherwise(0.0).alias("doubt"),
        F.when(inside, 0.0).otherwise(G.point_distance(x, y, box)).alias("away"), det.alias("det_id"), confidence.alias("confidence"), box.alias("box"),
    )


def views(images: DataFrame, detections: DataFrame, axis_x: float = 0.5, threshold: float = 0.75, low: str = "original_low_bottle_confidence") -> DataFrame:
    """One or two views per image: label and bottle with confidences, crops and mode; diagnostics repeat on every view.

    Without a label the view is the whole frame with the best selected bottle. Images and boxes are shuffled once, together; windows
    and one aggregation over the image do the rest in the same partitions, and no image's boxes are gathered in a row.
    """
    whole = Window.partitionBy("image_id")
    none = lambda *names: [F.lit(None).cast(detections.schema[c].dataType).alias(c) for c in names]
    boxes = ("det_id", "class_id", "confidence", "box")
    sizes = images.select("image_id", "width", "height", F.lit(True).alias("known"), *none(*boxes))
    rows = sizes.unionByName(detections.select("image_id", *boxes), allowMissingColumns=True)
    rows = rows.withColumns({c: F.max(c).over(whole) for c in ("width", "height", "known")}).where("known").drop("known")
    there = F.col("det_id").isNotNull()
    rows = rows.withColumn("distance", F.when(there, G.axis_distance(F.col("box"), F.col("width"), axis_x)))
    rows = rows.withColumn("score", F.when(there, G.selection_score(F.col("confidence"), F.col("distance"))))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), "det_id")))
    target = F.struct("det_id", "score", "distance", "confidence", "box")
    is_label, is_bottle = there & (F.col("class_id") == LABEL), there & (F.col("class_id") == BOTTLE)
    rows = rows.withColumns({f"label_{k}": F.max(F.when(is_label & (F.col("place") == k), target)).over(whole) for k in (1, 2)})
    rival = lambda k: F.min(F.when(is_bottle & F.col(f"label_{k}").isNotNull(), _rivalry(F.col(f"label_{k}"), F.col("box"), F.col("confidence"), F.col("det_id")))).alias(f"rival_{k}")
    found = rows.groupBy("image_id", "width", "height").agg(
        F.count_if(is_bottle).alias("bottle_detections"), F.count_if(is_label).alias("label_detections"), *(F.first(f"label_{k}").alias(f"label_{k}") for k in (1, 2)),
        *(F.max(F.when(is_bottle & (F.col("place") == k), target)).alias(f"bottle_{k}") for k in (1, 2)), rival(1), rival(2),
    )
    found = found.withColumn("label_ambiguous", _ambiguous(F.col("label_1"), F.col("label_2"), LABELS)).withColumn("bottle_ambiguous", _ambiguous(F.col("bottle_1"), F.col("bottle_2"), BOTTLES))
    view = lambda k, label, bottle: F.struct(
        F.lit(k).alias("view"), *(F.col(label)[c].alias(f"label_{n}") for c, n in (("det_id", "det"), ("confidence", "confidence"), ("box", "box"))),
        *(F.col(bottle)[c].alias(f"bottle_{n}") for c, n in (("det_id", "det"), ("confidence", "confidence"), ("box", "box"))),
    )
    made = F.when(F.col("label_1").isNull(), F.array(view(1, "label_1", "bottle_1"))).when(F.col("label_ambiguous"), F.array(view(1, "label_1", "rival_1"), view(2, "label_2", "rival_2"))).otherwise(F.array(view(1, "label_1", "rival_1")))
    kept = ["image_id", "width", "height", "bottle_detections", "label_detections", "bottle_ambiguous", "label_ambiguous"]
    return _crops(found.select(*kept, F.inline(made)), threshold, low)


def crop_names(view_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(image_id, view, label_name, bottle_name) from views and (image_id, path)."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = view_rows.join(paths, "image_id")
    named = lambda part: G.crop_name(F.col("path"), stem, F.col("view"), part)
    return rows.select("image_id", "view", F.when(F.col("label_box").isNotNull(), named("label")).alias("label_name"), named("bottle").alias("bottle_name"))


