"""Column functions over boxes: axis scores, overlaps, distances, padded crops. A box is a struct (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def axis_distance(b: Column, image_width: Column, axis_x: float = 0.5) -> Column:
    """Horizontal distance of a box's centre from the axis, in image widths; an error for widths of 0 or less."""
    if not 0 <= axis_x <= 1:
        raise ValueError("axis_x must lie between 0 and 1")
    width = F.when(image_width > 0, image_width).otherwise(F.raise_error(F.lit("image width must be positive")).cast("double"))
    return F.abs((b.x1 + b.x2) * 0.5 / width - F.lit(axis_x))


def axis_proximity(distance: Column, sigma: float = 0.2) -> Column:
    """1 on the axis, falling off as a Gaussian."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return F.exp(-0.5 * F.pow(distance / F.lit(sigma), F.lit(2.0)))


#: Places of a selection score and of gaps between two: no order and no threshold hangs on the last bit of exp, which libraries give differently.
PLACES = 9


def selection_score(confidence: Column, distance: Column, weight: float = 0.2, sigma: float = 0.2) -> Column:
    """Confidence plus a bounded bonus for closeness to the axis, to ``PLACES`` places."""
    if weight < 0:
        raise ValueError("weight must not be negative")
    return F.round(confidence.cast("double") + F.lit(weight) * axis_proximity(distance, sigma), PLACES)


def crosshair_axis(crosshair_x: Column, image_width: Column | None = None) -> tuple[Column, Column]:
    """(axis, width) for callers that know only a crosshair: without a width the crosshair counts as the centre."""
    width = F.greatest(2.0 * crosshair_x, F.lit(1.0))
    width = width if image_width is None else F.when(image_width != 0, image_width).otherwise(width)
    return crosshair_x / width, width


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    common = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def point_distance(x: Column, y: Column, b: Column) -> Column:
    """Distance of a point to a box, 0 inside."""
    return F.hypot(F.greatest(b.x1 - x, F.lit(0.0), x - b.x2), F.greatest(b.y1 - y, F.lit(0.0), y - b.y2))


def padded_box(b: Column, width: Column, height: Column, padding: float) -> Column:
    """Whole-pixel box, widened by a share of its size on every side and clamped to the image."""
    dx, dy = (b.x2 - b.x1) * padding, (b.y2 - b.y1) * padding
    return F.struct(
        F.greatest(F.lit(0), F.floor(b.x1 - dx)).cast("int").alias("x1"),
        F.greatest(F.lit(0), F.floor(b.y1 - dy)).cast("int").alias("y1"),
        F.least(width, F.ceil(b.x2 + dx)).cast("int").alias("x2"),
        F.least(height, F.ceil(b.y2 + dy)).cast("int").alias("y2"),
    )


def crop_mode(confidence: Column, threshold: float = 0.75, low: str = "original_low_bottle_confidence") -> Column:
    """How the body image is cut: no box, a box too weak to trust, or a crop. ``low`` names the second."""
    return F.when(confidence.isNull(), "original_no_bottle").when(confidence < threshold, low).otherwise("yolo_bottle_crop")


def crop_name(path: Column, stem: Column, candidate: Column, part: str) -> Column:
    """File name of a crop: stem, ten digits of the path's SHA-1, candidate number and part."""
    return F.concat(stem, F.lit("__"), F.substring(F.sha1(path), 1, 10), F.lit("__c"), candidate.cast("string"), F.lit(f"_{part}"))
