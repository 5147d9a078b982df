"""Vectors as z, y, x triples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "") -> Vec:
    return F.col(f"{prefix}z"), F.col(f"{prefix}y"), F.col(f"{prefix}x")


def lit(z: float, y: float, x: float) -> Vec:
    return F.lit(float(z)), F.lit(float(y)), F.lit(float(x))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def equal(a: Vec, b: Vec) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    """The cross product taken in z, y, x order: the negative of the right-handed one in x, y, z."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """The unit vector; zero stays zero."""
    n = length(a)
    return tuple(F.when(n > 0, p / n).otherwise(F.lit(0.0)) for p in a)
