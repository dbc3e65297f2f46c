"""Queries over detection boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogmatch.functions import geometry as G
from catalogmatch.operators import detections as D
from catalogmatch.plans.inputs import boxed, cte, frame, image_sizes, table
from catalogmatch.sources.sinks import kept_table


def _inputs(spark, sf):
    found = boxed(kept_table(frame(spark, sf, "detections"), "detections"))
    return image_sizes(found), D.confident(found)


def b8_class_counts(spark, sf):
    return D.class_counts(_inputs(spark, sf)[1])


def b9_confident(spark, sf):
    return D.confident(boxed(frame(spark, sf, "detections")), 0.10).select("image_id", "det_id", "confidence")


def d2_selection_modes(spark, sf):
    return D.selection_modes(*_inputs(spark, sf))


def _targets(spark, sf, kind, rule):
    images, found = _inputs(spark, sf)
    rows = D.select_targets(D.scored(found.where(F.col("class_id") == kind), images), rule)
    return rows.select("image_id", "det_id", "place", "ambiguous", F.round("score", 6).alias("score"))


def e6_label_targets(spark, sf):
    return _targets(spark, sf, D.LABEL, D.LABELS)


def e7_bottle_targets(spark, sf):
    return _targets(spark, sf, D.BOTTLE, D.BOTTLES)


def e8_pairs(spark, sf):
    _, found = _inputs(spark, sf)
    return D.pair_bottles(found.where(F.col("class_id") == D.LABEL), found.where(F.col("class_id") == D.BOTTLE)).select("image_id", "det_id", "bottle_det")


def h12_axis_scores(spark, sf):
    images, found = _inputs(spark, sf)
    rows = D.scored(found, images)
    axis, width = G.crosshair_axis(F.lit(500.0))
    legacy = G.selection_score(F.col("confidence"), F.abs((F.col("box.x1") + F.col("box.x2")) * 0.5 / width - axis))
    return rows.select("image_id", "det_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), F.round(legacy, 6).alias("legacy_score"))


def h16_padded_crops(spark, sf):
    images, found = _inputs(spark, sf)
    crop = G.padded_box(F.col("box"), F.col("width"), F.col("height"), 0.10)
    return found.join(images, "image_id").select("image_id", "det_id", *(crop[c].alias(c) for c in ("x1", "y1", "x2", "y2")))


def h20_crop_names(spark, sf):
    paths = table(spark, sf, "pages")
    return paths.select("page_id", G.crop_name(F.col("url"), F.concat(F.lit("page"), F.col("page_id").cast("string")), F.col("page_id") % 2 + 1, "label").alias("name"))


def i5_views(spark, sf):
    rows = D.views(*_inputs(spark, sf))
    flat = [F.col(f"{c}_crop.{k}").alias(f"{c}_{k}") for c in ("label", "bottle") for k in ("x1", "y1", "x2", "y2")]
    return rows.select("image_id", "view", "label_det", "bottle_det", "bottle_mode", "bottle_detections", "label_detections", "bottle_ambiguous", "label_ambiguous", *flat)


def _iou(a, b):
    common = f"(greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
    area = lambda t: f"(greatest(0, {t}x2 - {t}x1) * greatest(0, {t}y2 - {t}y1))"
    union = f"({area(a)} + {area(b)} - {common})"
    return f"(CASE WHEN {union} > 0 THEN {common} / {union} ELSE 0 END)"


SCORED = f"""WITH {cte("detections")}, det AS (SELECT *, abs((x1 + x2) * 0.5 / 1000 - 0.5) AS distance, round(confidence + 0.2 * exp(-0.5 * pow(abs((x1 + x2) * 0.5 / 1000 - 0.5) / 0.2, 2)), 9) AS score
FROM detections WHERE confidence >= 0.05), images AS (SELECT DISTINCT image_id FROM detections)"""


def _selected(name, kind, overlap, least):
    return f""", {name}_r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS place FROM det WHERE class_id = {kind}),
{name} AS (
  SELECT a.image_id, a.det_id, CAST(a.place AS INT) AS place, a.confidence, a.x1, a.y1, a.x2, a.y2, a.score,
    coalesce(round(abs(a.score - b.score), 9) <= 0.06 AND abs(a.distance - b.distance) <= 0.08 AND {_iou('a.', 'b.')} < {overlap} AND least(a.confidence, b.confidence) >= {least}, false) AS ambiguous
  FROM {name}_r a LEFT JOIN {name}_r b ON a.image_id = b.image_id AND b.place = 3 - a.place WHERE a.place <= 2
), {name}_s AS (SELECT * FROM {name} WHERE place = 1 OR ambiguous)"""


LABELS_SQL, BOTTLES_SQL = _selected("lab", 1, 0.5, 0), _selected("bot", 0, 0.8, 0.75)


def _paired(name, labels):
    return f""", {name}_c AS (
  SELECT l.*, b.det_id AS bottle_det, b.confidence AS bc, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
    (l.x1 + l.x2) * 0.5 BETWEEN b.x1 AND b.x2 AND (l.y1 + l.y2) * 0.5 BETWEEN b.y1 AND b.y2 AS inside, {_iou('l.', 'b.')} AS overlap,
    sqrt(pow(greatest(b.x1 - (l.x1 + l.x2) * 0.5, 0, (l.x1 + l.x2) * 0.5 - b.x2), 2) + pow(greatest(b.y1 - (l.y1 + l.y2) * 0.5, 0, (l.y1 + l.y2) * 0.5 - b.y2), 2)) AS dist
  FROM {labels} l LEFT JOIN det b ON l.image_id = b.image_id AND b.class_id = 0
), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY inside DESC NULLS LAST, CASE WHEN inside THEN overlap ELSE 0 END DESC, CASE WHEN inside THEN bc ELSE 0 END DESC,
  CASE WHEN inside THEN 0 ELSE dist END, bottle_det) AS n FROM {name}_c) WHERE n = 1)"""


def _crop(p, pad, when):
    return ", ".join(
        f"CASE WHEN {when} THEN CAST({e} AS INT) END AS {p}_{k}"
        for k, e in (
            ("x1", f"greatest(0, floor({p}x1 - ({p}x2 - {p}x1) * {pad}))"), ("y1", f"greatest(0, floor({p}y1 - ({p}y2 - {p}y1) * {pad}))"),
            ("x2", f"least(1000, ceil({p}x2 + ({p}x2 - {p}x1) * {pad}))"), ("y2", f"least(1400, ceil({p}y2 + ({p}y2 - {p}y1) * {pad}))"),
        )
    )


COUNTS_SQL = "counts AS (SELECT image_id, count(*) FILTER (class_id = 0) AS bottles, count(*) FILTER (class_id = 1) AS labels FROM det GROUP BY image_id)"
QUERIES = {
    f.__name__: f
    for f in (b8_class_counts, b9_confident, d2_selection_modes, e6_label_targets, e7_bottle_targets, e8_pairs, h12_axis_scores, h16_padded_crops, h20_crop_names, i5_views)
}
_TARGET = "SELECT image_id, det_id, place, ambiguous, round(score, 6) AS score FROM {0}_s"
ORACLES = {
    "b8_class_counts": f"{SCORED}, {COUNTS_SQL} SELECT * FROM counts",
    "b9_confident": f"WITH {cte('detections')} SELECT image_id, det_id, confidence FROM detections WHERE confidence >= 0.1",
    "d2_selection_modes": f"""{SCORED}, {COUNTS_SQL}{LABELS_SQL} SELECT i.image_id, coalesce(c.bottles, 0) AS bottles, coalesce(c.labels, 0) AS labels,
      CASE WHEN s.image_id IS NULL THEN 'no_label_detection' WHEN s.ambiguous THEN 'ambiguous_two_pairs' ELSE 'single_pair' END AS mode
      FROM images i LEFT JOIN counts c USING (image_id) LEFT JOIN lab_s s ON s.image_id = i.image_id AND s.place = 1""",
    "e6_label_targets": f"{SCORED}{LABELS_SQL} {_TARGET.format('lab')}",
    "e7_bottle_targets": f"{SCORED}{BOTTLES_SQL} {_TARGET.format('bot')}",
    "e8_pairs": f"{SCORED}, labels1 AS (SELECT * FROM det WHERE class_id = 1){_paired('pairs', 'labels1')} SELECT image_id, det_id, bottle_det FROM pairs",
    "h12_axis_scores": f"{SCORED} SELECT image_id, det_id, round(distance, 6) AS distance, round(score, 6) AS score, round(score, 6) AS legacy_score FROM det",
    "h16_padded_crops": f"""{SCORED} SELECT image_id, det_id, CAST(greatest(0, floor(x1 - (x2 - x1) * 0.1)) AS INT) AS x1, CAST(greatest(0, floor(y1 - (y2 - y1) * 0.1)) AS INT) AS y1,
      CAST(least(1000, ceil(x2 + (x2 - x1) * 0.1)) AS INT) AS x2, CAST(least(1400, ceil(y2 + (y2 - y1) * 0.1)) AS INT) AS y2 FROM det""",
    "h20_crop_names": "SELECT page_id, 'page' || CAST(page_id AS VARCHAR) || '__' || substr(sha1(url), 1, 10) || '__c' || CAST(page_id % 2 + 1 AS VARCHAR) || '_label' AS name FROM pages",
    "i5_views": f"""{SCORED}, {COUNTS_SQL}{LABELS_SQL}{BOTTLES_SQL}{_paired('pairs', 'lab_s')}, v AS (
      SELECT image_id, place AS view, det_id AS label_det, x1 AS labelx1, y1 AS labely1, x2 AS labelx2, y2 AS labely2, bottle_det, bc, bx1 AS bottlex1, by1 AS bottley1, bx2 AS bottlex2, by2 AS bottley2, ambiguous AS label_ambiguous FROM pairs
      UNION ALL SELECT i.image_id, 1, NULL, NULL, NULL, NULL, NULL, b.det_id, b.confidence, b.x1, b.y1, b.x2, b.y2, false FROM images i LEFT JOIN bot_s b ON b.image_id = i.image_id AND b.place = 1
      WHERE i.image_id NOT IN (SELECT image_id FROM lab_s))
      SELECT v.image_id, v.view, v.label_det, v.bottle_det, CASE WHEN bc IS NULL THEN 'original_no_bottle' WHEN bc < 0.75 THEN 'original_low_bottle_confidence' ELSE 'yolo_bottle_crop' END AS bottle_mode,
      coalesce(c.bottles, 0) AS bottle_detections, coalesce(c.labels, 0) AS label_detections, coalesce(s.ambiguous, false) AS bottle_ambiguous, v.label_ambiguous,
      {_crop('label', 0.1, 'label_det IS NOT NULL')}, {_crop('bottle', 0.06, 'bc >= 0.75')}
      FROM v LEFT JOIN counts c ON c.image_id = v.image_id LEFT JOIN bot_s s ON s.image_id = v.image_id AND s.place = 1""",
}
