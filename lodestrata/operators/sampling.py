"""Sampling cells at points: nearest, trilinear, and stacks of layers along a surface's normals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def voxel(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds v to points with whole z, y, x: the cell there, 0 without one."""
    return points.join(cells.select("z", "y", "x", "v"), ["z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def nearest(points: DataFrame, cells: DataFrame, key: str = "id") -> DataFrame:
    """(key, val): the cell nearest to each point (z, y, x), halves away from zero; 0 without one."""
    at = points.select(key, *[F.round(c).cast("int").alias(c) for c in "zyx"])
    return voxel(at, cells).select(key, F.col("v").alias("val"))


def corners(points: DataFrame, keep: list[str]) -> DataFrame:
    """Eight rows for each point: the whole places around it (cz, cy, cx) and their weights w."""
    base = points.select(*keep, *[F.floor(c).cast("int").alias(f"f{c}") for c in "zyx"], *[(F.col(c) - F.floor(c)).alias(f"r{c}") for c in "zyx"])
    side = lambda r, bit: r if bit else 1 - r
    made = F.array(*[F.struct(*[(F.col(f"f{n}") + b).alias(f"c{n}") for n, b in zip("zyx", bits, strict=True)], (side(F.col("rz"), bits[0]) * side(F.col("ry"), bits[1]) * side(F.col("rx"), bits[2])).alias("w")) for bits in CORNERS])
    return base.select(*keep, F.explode(made).alias("c")).select(*keep, "c.cz", "c.cy", "c.cx", "c.w")


def trilinear(points: DataFrame, cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, val): the trilinear value at each point; corners without a cell count as 0.

    Corners of no weight and corners where there can be no cell go before the join; the sum over a point's corners is
    combined before its shuffle.
    """
    keep = keep or ["id"]
    near = corners(points, keep).where("w > 0")
    at = cells.select(F.col("z").alias("cz"), F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").alias("_cell"))
    hit = near.join(at, ["cz", "cy", "cx"]).groupBy(*keep).agg(F.sum(F.col("w") * F.col("_cell")).alias("val"))
    return points.select(*keep).distinct().join(hit, keep, "left").withColumn("val", F.coalesce("val", F.lit(0.0)))


def march(surface: DataFrame, steps: list[float]) -> DataFrame:
    """(v, u, layer, t, z, y, x): each point of a surface moved along its normal by each step."""
    layers = F.posexplode(F.array(*[F.lit(float(t)) for t in steps])).alias("layer", "t")
    out = surface.select("*", layers)
    return out.select("v", "u", "layer", "t", *[(F.col(c) + F.col("t") * F.col(f"n{c}")).alias(c) for c in "zyx"])


def quad_stack(surface: DataFrame, cells: DataFrame, t0: float, dt: float, layers: int) -> DataFrame:
    """(layer, v, u, val): trilinear samples of layers at t0 + layer * dt along the normals."""
    return trilinear(march(surface, [t0 + i * dt for i in range(layers)]), cells, ["layer", "v", "u"])
