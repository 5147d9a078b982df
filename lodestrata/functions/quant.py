"""Band-weighted dead-zone quantisation and the reversible colour transform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: dead zone, reconstruction point within a step, weight exponent and gain.
DEAD_ZONE, RECON, EXPONENT, GAIN = 0.80, 0.40, 0.65, 3.0


def band_weight(share: Column) -> Column:
    """How much coarser a band is quantised; share is its place among the bands, 0 to 1."""
    return 1 + GAIN * F.pow(share, F.lit(EXPONENT))


def max_band(n: int, rank: int) -> int:
    return rank * (n - 1)


def step(band: Column, q: Column | float, top: int) -> Column:
    return q * band_weight(band / F.lit(float(top)))


def quantize(c: Column, step: Column) -> Column:
    """The signed index of a coefficient: 0 within the dead zone, and for steps that aren't positive."""
    t = F.try_divide(F.abs(c), step)
    size = F.floor(t - F.lit(DEAD_ZONE) + 1)
    return F.when((step <= 0) | (t < DEAD_ZONE), 0).otherwise(F.when(c < 0, -size).otherwise(size)).cast("int")


def dequantize(index: Column, step: Column) -> Column:
    """The value an index stands for."""
    size = (F.abs(index) - 1 + F.lit(DEAD_ZONE + RECON)) * step
    return F.when(index == 0, 0.0).otherwise(F.when(index < 0, -size).otherwise(size))


def ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(luma, orange, green) of a pixel."""
    co = r - b
    t = b + co / 2
    cg = g - t
    return t + cg / 2, co, cg


def rgb(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - cg / 2
    b = t - co / 2
    return b + co, cg + t, b
