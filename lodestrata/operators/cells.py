"""Sparse cells (z, y, x, v): masks, air, dense boxes and the resolution pyramid. An absent cell is air, and so is v = 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.keys import div


def mask(cells: DataFrame) -> DataFrame:
    """Adds mask: whether a cell holds material."""
    return cells.withColumn("mask", F.col("v") != 0)


def air_mask(cells: DataFrame, threshold: int) -> DataFrame:
    """The cells over the threshold; the others are air, and so go."""
    return cells.where(F.col("v") > threshold)


def downsample(cells: DataFrame) -> DataFrame:
    """The next coarser level: of each 2 x 2 x 2 group the mean of its material, rounded down; none without material.

    A partial sum and count for each group come before the one shuffle. Odd sides round up.
    """
    half = [div(F.col(c), 2).alias(c) for c in ("z", "y", "x")]
    return cells.where("v != 0").groupBy(*half).agg(F.floor(F.sum("v") / F.count("v")).cast("int").alias("v"))


def pyramid(cells: DataFrame, lods: int) -> DataFrame:
    """(lod, z, y, x, v) of all levels; each is made of the rounded level below it, so the levels are steps of one plan."""
    level = cells.where("v != 0").select("z", "y", "x", "v")
    out = level.select(F.lit(0).alias("lod"), "*")
    for lod in range(1, lods):
        level = downsample(level)
        out = out.unionByName(level.select(F.lit(lod).alias("lod"), "*"))
    return out


def ingest(cells: DataFrame, threshold: int, lods: int) -> DataFrame:
    """Masks air and builds the pyramid."""
    return pyramid(air_mask(cells, threshold), lods)


def box_grid(cells: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Every place (z, y, x) of a box."""
    z0, y0, x0 = low
    nz, ny, nx = size
    at = cells.sparkSession.range(max(0, nz) * max(0, ny) * max(0, nx))
    i = F.col("id")
    z, y, x = F.floor(i / (ny * nx or 1)), F.floor(i / (nx or 1)) % (ny or 1), i % (nx or 1)
    return at.select((z + z0).cast("int").alias("z"), (y + y0).cast("int").alias("y"), (x + x0).cast("int").alias("x"))


def dense_box(cells: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Every place of a box with its value, 0 where there is no cell. A box without extent is empty."""
    grid = box_grid(cells, low, size)
    return grid.join(cells.select("z", "y", "x", "v"), ["z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
