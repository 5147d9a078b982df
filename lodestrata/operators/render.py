"""Marching a surface through a volume and reducing each pixel's samples."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling


def steps(t0: float, t1: float, dt: float) -> list[float]:
    """The places of a march from t0 to t1 inclusive, by repeated addition in 32 bits, as renderers step."""
    if dt <= 0:
        raise ValueError("dt must be positive")
    out, t, last, d = [], np.float32(t0), np.float32(t1), np.float32(dt)
    while t <= last:
        out.append(float(t))
        t = np.float32(t + d)
    return out


def largest() -> Column:
    return F.greatest(F.lit(0.0), F.max("val"))


def least() -> Column:
    return F.coalesce(F.min("val"), F.lit(0.0))


def mean() -> Column:
    return F.coalesce(F.avg("val"), F.lit(0.0))


def alpha() -> Column:
    """Front to back: each sample is as opaque as it is bright, 255 being opaque. Samples are put in order of t first."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "val")))  # one for each step of the march
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("through"))

    def add(acc: Column, s: Column) -> Column:
        a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["val"] / 255))
        return F.struct((acc["sum"] + acc["through"] * a * s["val"]).alias("sum"), (acc["through"] * (1 - a)).alias("through"))

    return F.aggregate(ordered, start, add)["sum"]


COMPOSITORS = {"max": largest, "min": least, "mean": mean, "alpha": alpha}


def render(surface: DataFrame, cells: DataFrame, t0: float, t1: float, dt: float, composite: str = "max", rows: tuple[int, int] | None = None) -> DataFrame:
    """(v, u, px): the image of a surface, or of a band of its rows (first to last, exclusive)."""
    band = surface if rows is None else surface.where((F.col("v") >= rows[0]) & (F.col("v") < rows[1]))
    samples = sampling.trilinear(sampling.march(band, steps(t0, t1, dt)), cells, ["v", "u", "t"])
    return samples.groupBy("v", "u").agg(COMPOSITORS[composite]().alias("px"))
