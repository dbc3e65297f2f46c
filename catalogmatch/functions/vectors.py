"""Column functions over vectors (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays zero. The norm is the one element of an array, so that it is computed once and not for every element."""
    scaled = F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0)))
    return F.element_at(scaled, 1)


def pair_features(q: Column, r: Column) -> Column:
    """[q, r, |q - r|, q * r] as one vector, for training a reranker."""
    return F.concat(q, r, F.zip_with(q, r, lambda x, y: F.abs(x - y)), F.zip_with(q, r, lambda x, y: x * y))


def masked(v: Column, valid: Column) -> Column:
    """The vector, or zeros where the image behind it is invalid."""
    return F.when(F.coalesce(valid, F.lit(False)), v).otherwise(F.transform(v, lambda x: x * 0))


def residual_logit(base: Column, raw: Column, most: float = 2.5) -> tuple[Column, Column]:
    """(residual, final): a bounded correction of a base logit."""
    if most <= 0:
        raise ValueError("the bound of the residual must be positive")
    residual = F.lit(most) * F.tanh(F.coalesce(raw, F.lit(0.0)))
    return residual, base + residual


def base_logit(similarity: Column, temperature: float = 0.07) -> Column:
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return similarity / F.lit(temperature)
