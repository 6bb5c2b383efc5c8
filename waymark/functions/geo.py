"""Projections, encodings and great-circle distance as closed-form expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equal Earth projection (fixed values) and the scale of the location encoder.
A1, A2, A3, A4 = 1.340264, -0.081106, 0.000893, 0.003796
SCALE = 66.50336
#: Half the width of the Web Mercator plane in metres (fixed value), and its sphere.
MERCATOR_HALF = 20037508.3427892
MERCATOR_RADIUS = 6378137.0
EARTH_M = 6_371_008.8


def equal_earth(lat: Column, lon: Column) -> Column:
    """struct(x, y), scaled to the encoder's unit."""
    t = F.asin(F.lit(math.sqrt(3) / 2) * F.sin(F.radians(lat)))
    under = 3 * (9 * A4 * F.pow(t, F.lit(8)) + 7 * A3 * F.pow(t, F.lit(6)) + 3 * A2 * F.pow(t, F.lit(2)) + A1)
    x = 2 * math.sqrt(3) * F.radians(lon) * F.cos(t) / under
    y = A4 * F.pow(t, F.lit(9)) + A3 * F.pow(t, F.lit(7)) + A2 * F.pow(t, F.lit(3)) + A1 * t
    return F.struct((x * SCALE / 180).alias("x"), (y * SCALE / 180).alias("y"))


def web_mercator(lat: Column, lon: Column) -> Column:
    """struct(y, x) as parts of the half width. The poles have no y."""
    x = F.radians(lon) * MERCATOR_RADIUS
    y = F.when(F.abs(lat) < 90, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS)
    return F.struct((y / MERCATOR_HALF).alias("y"), (x / MERCATOR_HALF).alias("x"))


def basic_encoding(v: Column) -> Column:
    """cos(2 pi v) of all parts, then sin."""
    return F.concat(F.transform(v, lambda x: F.cos(2 * math.pi * x)), F.transform(v, lambda x: F.sin(2 * math.pi * x)))


def positional_encoding(v: Column, sigma: float, m: int) -> Column:
    """For each part of v the m cosines, then the m sines, of 2 pi sigma^(j/m) v."""
    rates = F.array(*[F.lit(2 * math.pi * sigma ** (j / m)) for j in range(m)])
    return F.flatten(F.transform(v, lambda x: F.concat(F.transform(rates, lambda r: F.cos(r * x)), F.transform(rates, lambda r: F.sin(r * x)))))


def gaussian_encoding(v: Column, b: list[list[float]]) -> Column:
    """cos(2 pi B v), then sin, for a given matrix B of one row per frequency."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in b])
    turn = F.transform(rows, lambda r: 2 * math.pi * F.aggregate(F.zip_with(r, v, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x))
    return F.concat(F.transform(turn, F.cos), F.transform(turn, F.sin))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
