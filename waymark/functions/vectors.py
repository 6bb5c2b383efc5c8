"""Vectors in array columns. Sums run in double; for products of many pairs see operators.ranking.knn."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.bind import bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """The zero vector stays as it is. Vector and norm are computed once, not once an element."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return bound(a, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def composite(*parts: Column) -> Column:
    """Each part to unit length, one after the other, the whole to unit length."""
    return l2_normalise(F.concat(*[l2_normalise(p) for p in parts]))


def image_vector(visual: Column, as_text: Column, as_place: Column) -> Column:
    return composite(visual, as_text, as_place)


def text_vector(as_image: Column, text: Column, width: int) -> Column:
    """A text has no place part: zeros in its stead."""
    return composite(as_image, text, F.array_repeat(F.lit(0.0), width))


def temperature(c: Column, low: float = 0.01, high: float = 0.5) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def class_balance(n: Column, beta: float) -> Column:
    """(1-b)/(1-b^n), 1 for b = 0; to be divided by its mean over the cells."""
    if beta == 0:
        return F.lit(1.0)
    return F.lit(1 - beta) / (1 - F.pow(F.lit(beta), n.cast("double")))


SQRT6 = math.sqrt(6)
